"""A full-text index as a table: blocks of posting lists with positions, phrase search and ranked search.

Documents are dealt into blocks by a hash of their id, and a block's posting lists
are made in one group. A row of the index holds what one term has in one block:
documents, their lengths and positions. So a heavy term has a row in each block
instead of one long list, and a document's terms stand in one block. Files are
those of a few blocks, parted by a hash of the term and sorted by term, so a search
reads the files and row groups of its terms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import settled, shared_folder

#: What words are: runs of letters and digits; capitals A to Z count as small letters.
WORD = r"[\p{L}\p{N}]+"
#: Documents of a block, about; folders of the index; the ranking's constants.
BLOCK, FOLDERS, K1, B = 1_024, 16, 1.2, 0.75
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


@dataclass
class Index:
    """postings (part, term, block, docs, lengths, tfs, starts, positions, df, total): a document's positions are tfs of them from starts on; terms (term, df) and the documents' number and mean length."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    mean: float
    blocks: int


def _part(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _lists(rows: pa.Table) -> pa.Table:
    """The posting lists of a block's documents (doc, block, words), by document and position."""
    rows = rows.combine_chunks().sort_by("doc")
    words = rows["words"].combine_chunks()
    lengths = words.value_lengths().to_numpy().astype(np.int64)
    encoded = words.flatten().dictionary_encode()
    codes = encoded.indices.to_numpy()
    doc = np.repeat(np.arange(len(lengths)), lengths)
    position = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(codes, kind="stable")
    codes, doc, position = codes[order], doc[order], position[order]
    starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])])  # of a document's positions
    tfs = np.diff(np.r_[starts, len(codes)])
    codes, doc = codes[starts], doc[starts]
    firsts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])  # of a term's documents
    offsets = pa.array(np.r_[firsts, len(codes)].astype(np.int32))
    several = lambda values: pa.ListArray.from_arrays(offsets, values)
    ends = pa.array(np.r_[starts[firsts], len(position)].astype(np.int32))
    starts -= np.repeat(starts[firsts], np.diff(np.r_[firsts, len(codes)]))
    return pa.table({
        "term": encoded.dictionary.take(pa.array(codes[firsts])),
        "block": pa.array(np.full(len(firsts), rows["block"][0].as_py(), np.int32)),
        "docs": several(rows["doc"].combine_chunks().take(pa.array(doc))),
        "lengths": several(pa.array(lengths[doc].astype(np.int32))),
        "tfs": several(pa.array(tfs.astype(np.int32))),
        "starts": several(pa.array(starts.astype(np.int32))),
        "positions": pa.ListArray.from_arrays(ends, pa.array(position.astype(np.int32))),
        "df": pa.array(np.diff(np.r_[firsts, len(codes)])),
        "total": pa.array(np.add.reduceat(tfs, firsts).astype(np.int64)),
    })


def build(docs: DataFrame, path: str | None = None, block: int = BLOCK) -> Index:
    """Index documents (doc, text) at a path, or in the shared folder. Ids are unique; null and empty texts have no postings but count as documents."""
    spark = docs.sparkSession
    documents = docs.count()
    blocks = max(1, -(-documents // block))
    dealt = docs.select("doc", "text", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int").alias("block"))
    dealt = dealt.repartition(max(spark.sparkContext.defaultParallelism, -(-blocks // 8)), "block")
    rows = dealt.select("doc", "block", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    schema = f"term string, block int, docs array<{docs.schema['doc'].dataType.simpleString()}>, lengths array<int>, tfs array<int>, starts array<int>, positions array<int>, df long, total long"
    lists = rows.groupBy("block").applyInArrow(_lists, schema).select(_part("term").alias("part"), "*")
    where = path or f"{shared_folder(spark)}/index-{spark.range(1).select(F.uuid()).first()[0]}"
    lists.sortWithinPartitions("part", "term", "block").write.mode("overwrite").partitionBy("part").parquet(where)
    postings = spark.read.parquet(where)
    total = postings.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    terms = settled(postings.groupBy("term").agg(F.sum("df").alias("df")))
    return Index(postings, terms, documents, total / documents if documents else 0.0, blocks)


def _asked(index: Index, queries: DataFrame) -> DataFrame:
    """(query, place, term, df, part) of the queries' words; df is null for words that no document has."""
    rows = queries.select("query", F.posexplode(words(F.col("text"))).alias("place", "term"))
    return settled(rows.join(index.terms, "term", "left").withColumn("part", _part("term")))


def _rows(index: Index, wanted: DataFrame) -> DataFrame:
    """Postings of the wanted terms (part, term, ...), exploded by document."""
    postings = index.postings.select("part", "term", "block", "docs", "tfs", "starts", "positions")
    found = settled(wanted).join(postings, ["part", "term"] + (["block"] if "block" in wanted.columns else []))
    own = F.transform(F.arrays_zip("docs", "tfs", "starts"), lambda e: F.struct(e["docs"].alias("doc"), F.slice("positions", e["starts"] + 1, e["tfs"]).alias("positions")))
    return found.withColumn("e", F.explode(own)).drop("docs", "tfs", "starts", "positions").select("*", "e.doc", "e.positions").drop("e")


def phrases(index: Index, queries: DataFrame) -> DataFrame:
    """(query, doc, hits): how often a query's words (query, text) stand one after another in a document, overlaps included.

    The rarest word of a query leads: the others are looked up only in its documents.
    Queries without words, or with one that no document has, have no rows.
    """
    asked = _asked(index, queries)
    whole = asked.groupBy("query").agg(F.count("*").alias("n"), F.min_by("place", F.struct("df", "place")).alias("lead"), F.count_if(F.col("df").isNull()).alias("missing")).filter("missing = 0").drop("missing")
    asked = settled(asked.join(whole, "query").select("query", "place", "term", "part", "n", (F.col("place") == F.col("lead")).alias("leads")))
    at = F.explode(F.transform("positions", lambda p: p - F.col("place"))).alias("start")
    first = settled(_rows(index, asked.filter("leads")).select("query", "n", "block", "doc", at).filter("start >= 0"))
    blocks = asked.filter("not leads").join(first.select("query", "block").distinct(), "query")
    other = _rows(index, blocks).join(first.select("query", "doc").distinct(), ["query", "doc"], "left_semi").select("query", "n", "block", "doc", at)
    starts = first.union(other).groupBy("query", "doc", "start", "n").agg(F.count("*").alias("found")).filter("found = n")
    return starts.groupBy("query", "doc").agg(F.count("*").alias("hits"))


def ranked(index: Index, queries: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query (query, text) by BM25; equal ones after rounding by id.

    The lists of the queries' words meet in groups of a block, where a query's scores are
    sums over the block's documents; a block hands on what can be among the first k.
    """
    asked = _asked(index, queries).filter("df is not null and query is not null").select("query", "term", "part", "df").distinct()
    rarity = F.log(1 + (F.lit(float(index.documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    wanted = settled(asked.groupBy("part", "term").agg(F.collect_list("query").alias("queries"), F.first(rarity).alias("rarity")))
    mean = index.mean or 1.0

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        flat = lambda name: rows[name].combine_chunks().flatten()
        docs = flat("docs").dictionary_encode()
        ids = docs.dictionary.take(pc.sort_indices(docs.dictionary))
        place = pc.index_in(docs.dictionary, ids).to_numpy()[docs.indices.to_numpy()]
        tf = flat("tfs").to_numpy().astype(float)
        sizes = rows["docs"].combine_chunks().value_lengths().to_numpy()
        weight = np.repeat(rows["rarity"].to_numpy(), sizes) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * flat("lengths").to_numpy() / mean))
        ends = np.cumsum(sizes)
        names = flat("queries").dictionary_encode()
        number = names.indices.to_numpy()
        order = np.argsort(number, kind="stable")
        terms = np.repeat(np.arange(len(rows)), rows["queries"].combine_chunks().value_lengths().to_numpy())[order]
        out = []
        for n, own in enumerate(np.split(terms, np.cumsum(np.bincount(number, minlength=len(names.dictionary)))[:-1])):
            at = np.concatenate([np.arange(ends[t] - sizes[t], ends[t]) for t in own])
            scores = np.bincount(place[at], weight[at], len(ids))
            first = np.argsort(-scores, kind="stable")[: np.count_nonzero(scores)]  # of equal ones the smaller id first
            found = scores[first]
            if len(first) > k:  # what may be equal to the k-th after rounding stays, but of equal scores k
                first = first[found >= found[k - 1] - 2 * 10.0**-digits]
                found = scores[first]
                starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
                run = np.arange(len(first)) - np.repeat(starts, np.diff(np.r_[starts, len(first)]))
                first, found = first[run < k], found[run < k]
            out.append((np.full(len(first), n), first, found))
        query, doc, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query": names.dictionary.take(pa.array(query)), "doc": ids.take(pa.array(doc)), "score": score})

    of = lambda df, name: df.schema[name].dataType
    schema = f"query {of(queries, 'query').simpleString()}, doc {of(index.postings, 'docs').elementType.simpleString()}, score double"
    met = index.postings.select("part", "term", "block", "docs", "lengths", "tfs").join(wanted, ["part", "term"]).drop("part", "term")
    tasks = max(met.sparkSession.sparkContext.defaultParallelism, -(-index.blocks // 8))
    rows = met.repartition(tasks, "block").groupBy("block").applyInArrow(best, schema)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", digits)), "doc")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "doc", "score", "rank")
