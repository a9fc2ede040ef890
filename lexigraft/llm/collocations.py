"""Phrase collocations, counted by counting quotient filters.

Texts are cut into pieces and words. Tasks hand on blocks of one language's words,
coded by a dictionary of the block's own; the vocabulary is summed from those
dictionaries, and words that stand often enough get a number. Phrases of those words
are counted as packed ids: every task fills a filter of its own shard
(quotient_filter.py), cuts it by ranges of the quotient, and Spark brings a range's
filters together, where they are merged in order. A task holds a range, and a common
phrase is one entry of each shard.

A longer phrase is counted only where both shorter ones in it are frequent. Tasks
know the frequent ones by a bitmap of fixed size, which says yes too often at times
and never no: it spares work and changes no count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quotient_filter import Filter, pack, permute
from .shared import materialise
from .words import slices, words

#: Words of the longest phrase; how often a phrase has to stand; phrases that a language reports.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Words of a block; entries of a task's filter before it is handed on; entries that a range of quotients is made for.
BLOCK, ENTRIES, RANGE = 1 << 18, 1 << 20, 1 << 21
#: Bits of the map of frequent phrases that every task gets (2 MB).
SLOTS = 24
#: Frequent words that are sent to every task at most, more are joined; candidates that are broadcast at most, more are joined.
SENT, FEW = 1 << 20, 1 << 18
#: Parts of a language whose first phrases are found apart.
PARTS = 64
UNKNOWN = "und"

_PIECE = np.zeros(256, bool)
_PIECE[[*b".,;:!?", 10, 11, 12, 13]] = True
_BETWEEN = _PIECE.copy()
_BETWEEN[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def first_places(kind: np.ndarray) -> np.ndarray:
    """Where each number first stands in a list whose numbers begin at 0 and grow by one."""
    return np.flatnonzero(np.diff(np.maximum.accumulate(kind), prepend=-1))


def alike(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kind: np.ndarray) -> bool:
    """Whether all words of a kind are equal byte by byte."""
    first = first_places(kind)
    if not np.array_equal(sizes, sizes[first][kind]):
        return False
    for lo in range(0, len(starts), BLOCK):
        size = sizes[lo : lo + BLOCK]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        if not np.array_equal(data[np.repeat(starts[lo : lo + BLOCK], size) + within], data[np.repeat(starts[first][kind[lo : lo + BLOCK]], size) + within]):
            return False
    return True


def coded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The texts' words as codes from 1, with a 0 before each piece; the text of each code; the words, by code."""
    low = _LOWER[data]
    rows, starts, ends, hashes = words(low, offsets, lower=False, between=_BETWEEN)
    whole = low.tobytes()
    kind, _ = pd.factorize(hashes)
    if not alike(low, starts, ends - starts, kind):  # two words share a hash
        kind, _ = pd.factorize(np.array([whole[a:b] for a, b in zip(starts, ends, strict=True)], object))
    pieces = np.concatenate([[0], np.cumsum(_PIECE[low])])
    apart = np.ones(len(rows), bool)
    apart[1:] = (pieces[starts[1:]] != pieces[ends[:-1]]) | (rows[1:] != rows[:-1])
    place = np.arange(len(rows)) + np.cumsum(apart)
    codes, texts = np.zeros(len(rows) + int(apart.sum()), np.int64), np.zeros(len(rows) + int(apart.sum()), np.int64)
    codes[place], texts[place], texts[place[apart] - 1] = kind + 1, rows, rows[apart]
    return codes, texts, [whole[starts[i] : ends[i]].decode("utf-8", "replace") for i in first_places(kind)]


def packed(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype(np.uint32).tobytes(), "zstd", asbytes=True)


def unpacked(codes: pa.BinaryScalar, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(codes.as_buffer(), 4 * size, "zstd"), np.uint32).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, lang, size, codes, words, counts) of rows (lang, text). A text is never cut, so a phrase is never cut either."""
    task, serial = TaskContext.get().partitionId() << 32, 0
    held: dict[str, list[tuple[np.ndarray, list[str]]]] = {}
    sizes: dict[str, int] = {}

    def emit(name: str) -> pa.RecordBatch:
        nonlocal serial
        found: dict[str, int] = {}
        whole = np.concatenate([np.array([0, *(found.setdefault(w, len(found) + 1) for w in own)])[codes] for codes, own in held.pop(name)])
        counts = np.bincount(whole, minlength=len(found) + 1)[1:]
        serial += 1
        sizes.pop(name)
        columns = {"block": [task + serial], "lang": [name], "size": [len(whole)], "codes": [packed(whole)], "words": [list(found)], "counts": [counts]}
        kinds = {"block": pa.int64(), "lang": pa.string(), "size": pa.int64(), "codes": pa.binary(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64())}
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) for c in columns], names=list(columns))

    for batch in batches:
        langs, names = pd.factorize(np.array(batch.column(0).to_pylist(), object))
        for lo, hi, data, offsets in slices(batch.column(1), 1 << 20):
            codes, texts, spelt = coded(data, offsets)
            of = langs[lo:hi][texts]
            for i in np.unique(of):
                used, own = np.unique(codes[of == i], return_inverse=True)  # the first is 0
                name = names[i]
                held.setdefault(name, []).append((own, [spelt[k - 1] for k in used[1:]]))
                sizes[name] = sizes.get(name, 0) + len(own)
                if sizes[name] >= BLOCK:
                    yield emit(name)
            while sum(sizes.values()) >= 8 * BLOCK:
                yield emit(max(sizes, key=sizes.get))
    for name in list(held):
        yield emit(name)


def renumbered(codes: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Codes by a list of ids plus 1 for each code, 0 for none; one 0 parts two runs."""
    codes = own[codes]
    kept = codes != 0
    kept[1:] |= codes[:-1] != 0
    return codes[kept]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, codes) of rows (size, codes, found): codes become ids plus 1, 0 stands for whatever parts and words without an id."""
    for batch in batches:
        sizes, out = [], []
        for i in range(batch.num_rows):
            found = batch.column(2)[i]
            if not found.is_valid:
                continue
            codes = unpacked(batch.column(1)[i], batch.column(0)[i].as_py())
            pos, ids = (found.values.field(k).to_numpy() for k in (0, 1))
            own = np.zeros(int(max(codes.max(), pos.max())) + 1, np.int64)
            own[pos] = ids + 1
            codes = renumbered(codes, own)
            sizes.append(len(codes))
            out.append(packed(codes))
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["size", "codes"])


def numbered(blocks: DataFrame, frequent: DataFrame, many: int) -> DataFrame:
    """The blocks (size, codes) by ids of frequent words (lang, word, id), `many` of them.

    Few words go to every task; of more than SENT the blocks' dictionaries are joined with the vocabulary.
    """
    if many <= SENT:
        words_of: dict[str, tuple[pa.Array, np.ndarray]] = {}
        for lang, own in frequent.select("lang", "word", "id").toPandas().groupby("lang"):
            words_of[lang] = pa.array(own["word"], pa.string()), own["id"].to_numpy(np.int64)
        sent = blocks.sparkSession.sparkContext.broadcast(words_of)

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes, out = [], []
                for lang, size, codes, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    if lang not in sent.value:
                        continue
                    known, ids = sent.value[lang]
                    at = pc.index_in(names.values, value_set=known)
                    own = np.zeros(len(at) + 1, np.int64)
                    hit = at.is_valid().to_numpy(zero_copy_only=False)
                    own[1:][hit] = ids[at.drop_null().to_numpy()] + 1
                    found = renumbered(unpacked(codes, size), own)
                    sizes.append(len(found))
                    out.append(packed(found))
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["size", "codes"])

        return blocks.select("lang", "size", "codes", "words").mapInArrow(look_up, "size long, codes binary")
    own = blocks.select("block", "lang", F.posexplode("words").alias("pos", "word")).join(frequent.select("lang", "word", "id"), ["lang", "word"])
    found = own.groupBy("block").agg(F.collect_list(F.struct((F.col("pos") + 1).cast("long").alias("pos"), "id")).alias("found"))
    return blocks.select("block", "size", "codes").join(found, "block").select("size", "codes", "found").mapInArrow(_numbered, "size long, codes binary")


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """The first places of runs of k ids."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    gaps = np.concatenate([[0], np.cumsum(codes == 0)])
    return np.flatnonzero(gaps[k:] == gaps[: n])


def slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """The places of phrases in the bitmap."""
    return (permute(pack(ids, bits), bits)[:, 0] >> np.uint64(64 - SLOTS)).astype(np.int64)


def frequent_phrases(blocks: DataFrame, k: int, bits: int, known: np.ndarray | None, least: int, tokens: int) -> DataFrame:
    """(ids, f, slot) of all phrases of k words that stand `least` times or more.

    known: the bitmap of frequent phrases of k - 1 words. tokens bounds the entries, from which the ranges are set.
    """
    spark = blocks.sparkSession
    cut = min(max(0, int(-(-tokens // RANGE) - 1).bit_length()), 2 * bits)
    sent = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Filter] = []

        def parts() -> Iterator[pa.RecordBatch]:
            found = list(Filter.merged(held).split(cut))
            held.clear()
            for lo in range(0, len(found), 64):
                some = found[lo : lo + 64]
                yield pa.RecordBatch.from_arrays([pa.array([f.prefix for f in some], pa.int64()), pa.array([f.encode() for f in some], pa.binary())], names=["range", "filter"])

        for batch in batches:
            for size, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = unpacked(data, size)
                at = windows(codes, k)
                if sent.value is not None and len(at):
                    shorter = np.zeros(len(codes), bool)
                    inner = windows(codes, k - 1)
                    places = slots(np.lib.stride_tricks.sliding_window_view(codes, k - 1)[inner] - 1, bits)
                    shorter[inner] = sent.value[places >> 3] >> (places & 7).astype(np.uint8) & 1
                    at = at[shorter[at] & shorter[at + 1]]
                if not len(at):
                    continue
                held.append(Filter.of(pack(np.lib.stride_tricks.sliding_window_view(codes, k)[at] - 1, bits), bits))
                if sum(len(f.keys) for f in held) >= ENTRIES:
                    held[:] = [Filter.merged(held)]
                    if len(held[0].keys) >= ENTRIES // 2:
                        yield from parts()
        if held:
            yield from parts()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, main, held = None, 0, []

        def often() -> pa.RecordBatch:
            whole = Filter.merged(held)
            ids, counts = Filter(whole.keys[whole.counts >= least], whole.counts[whole.counts >= least], bits).entries(k)
            cuts = pa.array(np.arange(0, k * len(ids) + 1, k, dtype=np.int32))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, pa.array(ids.ravel())), pa.array(counts), pa.array(slots(ids, bits))], names=["ids", "f", "slot"])

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if name != at:
                    if held:
                        yield often()
                    at, main, held = name, 0, []
                held.append(Filter.decode(data.as_buffer()))
                if sum(len(f.keys) for f in held) - main > max(main, RANGE // 8):
                    held = [Filter.merged(held)]
                    main = len(held[0].keys)
        if held:
            yield often()

    shards = blocks.mapInArrow(count, "range long, filter binary")
    return shards.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "ids array<long>, f long, slot long")


def bitmap(found: DataFrame) -> np.ndarray:
    """The slots of frequent phrases as 2**SLOTS bits; Spark unites them by words of 64 bits."""
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = found.groupBy(F.expr("slot >> 6").alias("w")).agg(F.bit_or(one).alias("v")).toPandas()  # at most 2**18 rows
    out = np.zeros(1 << SLOTS - 6, np.int64)
    out[rows["w"].to_numpy(np.int64)] = rows["v"].to_numpy(np.int64)
    return out.astype("<i8").view(np.uint8)


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    docs needs lang and text; other columns don't matter. A null lang counts as
    `und`, a null text as empty. Equal scores fall to the more frequent phrase, then
    to the smaller in byte order. Repeated rows count each. A table without phrases
    that stand `least` times gives no rows. Scores are exact as long as
    1000 * a * n has 38 digits at most.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = materialise(rows.mapInArrow(_blocks, "block long, lang string, size long, codes binary, words array<string>, counts array<long>"), "blocks")
    counted = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("f"))
    vocabulary = materialise(counted, "vocabulary")
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    tokens, many = vocabulary.agg(F.coalesce(F.sum("f"), F.lit(0)), F.count_if(F.col("f") >= least)).first()

    # numbers without a sort of all words: the table's parts take turns
    row = F.monotonically_increasing_id()
    turns = vocabulary.rdd.getNumPartitions()
    frequent = materialise(vocabulary.filter(F.col("f") >= least).withColumn("id", row.bitwiseAND((1 << 33) - 1) * turns + F.shiftright(row, 33)), "frequent")
    bits = int(frequent.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]).bit_length() or 1
    if bits > 32:
        raise ValueError("over 2**32 frequent words")
    ids = materialise(numbered(blocks, frequent, many), "ids")

    whole, known = frequent.select(F.array("id").alias("ids"), "f"), None
    found: DataFrame | None = None
    for k in range(2, longest + 1):
        level = materialise(frequent_phrases(ids, k, bits, known, least, tokens), f"phrases{k}")
        found = level.select("ids", "f") if found is None else found.union(level.select("ids", "f"))
        if k < longest:
            known = bitmap(level)
            if not known.any():
                break
    few = found.count() <= FEW
    return ranked(found, whole.union(found), frequent, totals, top, F.broadcast if few and many <= FEW else lambda df: df)


def ranked(found: DataFrame, counts: DataFrame, frequent: DataFrame, totals: DataFrame, top: int, sent: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Score candidates (ids, f) by their worst cut, drop those that a longer one explains, and rank the rest by language.

    A candidate's word at place k and its cut after k words are one row, so all are brought together once.
    sent: what is done to tables of candidates and words before they are joined, broadcast() if they are few.
    """
    size = F.size("ids")
    longer = found.filter(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "f")
    longer = longer.groupBy("ids").agg(F.max("f").alias("over"))  # what is longer still stands no more often
    kept = found.join(sent(longer), "ids", "left").filter("over is null or over < f").select("ids", F.col("f").alias("a"))

    rows = kept.select("ids", "a", F.posexplode("ids").alias("k", "id")).join(sent(frequent.select("id", "lang", "word").join(totals, "lang")), "id")
    cut = lambda part: F.when(F.col("k") > 0, part).otherwise(F.col("ids"))  # noqa: E731  its first word has no cut; the candidate itself is there to be found
    rows = rows.withColumns({"left": cut(F.slice("ids", F.lit(1), F.greatest("k", F.lit(1)))), "right": cut(F.slice("ids", F.col("k") + 1, size - F.col("k")))})
    rows = rows.join(sent(counts.select(F.col("ids").alias("left"), F.col("f").alias("l"))), "left").join(sent(counts.select(F.col("ids").alias("right"), F.col("f").alias("r"))), "right")
    score = F.expr("(cast(1000 * cast(a as decimal(20, 0)) * cast(n as decimal(18, 0)) as decimal(38, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    rows = rows.groupBy("ids", "a").agg(
        F.first("lang").alias("lang"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("k", "word"))).alias("w"), F.min(F.when(F.col("k") > 0, F.struct(score.alias("score"), "k", "l", "r"))).alias("best")
    )
    scored = rows.select("lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"), "a", "best.l", "best.r", "n", "best.score")

    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    few = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    few = few.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_place") <= top)
    out = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
