"""Annotated corpora written by Spark as text and XML files and read again: orders are documents, their lines are annotations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..sources import annotated
from .base import query, table
from .document_queries import LINES, line_arrays

#: Documents of an XML file at most: one task reads a whole file.
FILE_DOCUMENTS = 100_000

#: A mention stands after the mentions before it in the abstract, which stands after the title.
SPANS = f"""WITH {LINES}, w AS (SELECT l_orderkey AS k, pos, 'P' || CAST(l_partkey AS VARCHAR) AS mention, CAST(l_suppkey AS VARCHAR) AS code, l_returnflag AS kind FROM lines),
s AS (SELECT *, 'Order ' || CAST(k AS VARCHAR) AS title, CAST(coalesce(sum(length(mention) + 1) OVER (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS place FROM w),
d AS (SELECT CAST(k AS VARCHAR) AS pmid, title, string_agg(mention, ' ' ORDER BY pos) AS abstract,
  string_agg(CAST(length(title) + 1 + place AS VARCHAR) || '-' || CAST(length(title) + 1 + place + length(mention) AS VARCHAR) || ':' || mention || ':' || kind || ':' || code, ',' ORDER BY pos) AS entities, string_agg(code, ',' ORDER BY pos) AS codes, count(*) AS n FROM s GROUP BY k, title)"""


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """(key, title, abstract, words array<struct<mention, code, kind, at>>), at being a mention's place in the abstract."""
    docs = line_arrays(spark, sf, mention=F.concat(F.lit("P"), F.col("l_partkey").cast("string")), code=F.col("l_suppkey").cast("string"), kind=F.col("l_returnflag"))
    at = lambda i: F.coalesce(F.aggregate(F.slice("lines", F.lit(1), i), F.lit(0), lambda s, x: s + F.char_length(x["mention"]) + 1), F.lit(0))
    words = F.transform("lines", lambda x, i: F.struct(x["mention"].alias("mention"), x["code"].alias("code"), x["kind"].alias("kind"), at(i).alias("at")))
    key = F.col("doc").cast("string")
    return docs.select(key.alias("key"), F.concat(F.lit("Order "), key).alias("title"), F.array_join(F.transform("lines", lambda x: x["mention"]), " ").alias("abstract"), words.alias("words"))


def described(docs: DataFrame) -> DataFrame:
    """Raw documents in plain columns."""
    entity = lambda e: F.concat_ws(":", F.concat_ws("-", e["start"].cast("string"), e["end"].cast("string")), e["mention"], e["entity_type"], e["code"])
    relation = lambda r: F.concat_ws("-", r["subject"], r["object"])
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return docs.select("pmid", "title", "abstract", joined("entities", entity).alias("entities"), joined("relations", relation).alias("relations"))


def following(words: Column) -> Column:
    """Each word with the one after it."""
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), i.alias("i"))))


@query(f"""{SPANS}, r AS (SELECT a.k, string_agg(a.code || '-' || b.code, ',' ORDER BY a.pos) AS relations FROM s a JOIN s b ON b.k = a.k AND b.pos = a.pos + 1 GROUP BY a.k)
SELECT pmid, title, abstract, entities, coalesce(relations, '') AS relations FROM d LEFT JOIN r ON CAST(k AS VARCHAR) = pmid""")
def q72_pubtator_files(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of lines parted by empty lines, in files whose lines end in one way or the other."""
    path = f"{H.shared_folder(spark)}/pubtator-{uuid.uuid4().hex}"
    docs = orders(spark, sf)
    begin = F.char_length("title") + 1
    line = lambda *fields: F.concat_ws("\t", F.col("key"), *fields)
    entity = lambda w: line((begin + w["at"]).cast("string"), (begin + w["at"] + F.char_length(w["mention"])).cast("string"), w["mention"], w["kind"], w["code"])
    relations = F.coalesce(F.transform(following(F.col("words")), lambda p: line(F.lit("CID"), p["a"]["code"], p["b"]["code"])), F.array().cast("array<string>"))
    block = F.concat(F.array(F.concat("key", F.lit("|t|"), "title"), F.concat("key", F.lit("|a|"), "abstract")), F.transform("words", entity), relations)
    odd = F.col("key").cast("long") % 2 == 1
    for name, own, end in (("a", ~odd, "\n"), ("b", odd, "\r\n")):
        docs.filter(own).select(F.concat(F.array_join(block, end), F.lit(end)).alias("value")).write.option("lineSep", end).text(f"{path}/{name}")
    return described(annotated.read_pubtator(spark, f"{path}/*"))


def bioc(spark: SparkSession, sf: str, silver: bool) -> DataFrame:
    """The orders through BioC-XML, whose passages lie further apart than in the joined text."""
    path = f"{H.shared_folder(spark)}/bioc-{uuid.uuid4().hex}"
    infons = lambda **values: F.array(*(F.struct(F.lit(k).alias("_key"), v.alias("_VALUE")) for k, v in values.items()))
    gap = F.char_length("title") + 50
    annotation = F.transform("words", lambda w, i: F.struct(
        F.concat(F.lit("T"), i).alias("_id"), infons(type=w["kind"], identifier=w["code"]).alias("infon"),
        F.array(F.struct((gap + w["at"]).alias("_offset"), F.char_length(w["mention"]).alias("_length"))).alias("location"), w["mention"].alias("text"),
    ))
    none = F.array().cast("array<struct<_id: string, infon: array<struct<_key: string, _VALUE: string>>, location: array<struct<_offset: int, _length: int>>, text: string>>")
    passages = F.array(
        F.struct(infons(type=F.lit("title")).alias("infon"), F.lit(0).alias("offset"), F.col("title").alias("text"), none.alias("annotation")),
        F.struct(infons(type=F.lit("abstract")).alias("infon"), gap.alias("offset"), F.col("abstract").alias("text"), annotation.alias("annotation")),
    )
    node = lambda role, i: F.struct(F.lit(role).alias("_role"), F.concat(F.lit("T"), i).alias("_refid"))
    relation = F.transform(following(F.col("words")), lambda p: F.struct(
        infons(type=F.lit("CID"), score=F.lit("0.5"), role1=p["a"]["code"], role2=p["b"]["code"]).alias("infon"), F.array(node("Subject", p["i"]), node("Object", p["i"] + 1)).alias("node"),
    ))
    docs = orders(spark, sf).select(F.col("key").alias("id"), passages.alias("passage"), relation.alias("relation"))
    xml = docs.write.format("xml").options(rootTag="collection", rowTag="document", indent="", compression="gzip", maxRecordsPerFile=FILE_DOCUMENTS)
    xml.save(f"{path}/whole")
    if silver:  # a broken document for every tenth order
        broken = F.concat(F.lit("<document><id>"), "key", F.lit("</id><passage><offset>none</offset></passage></document>"))
        orders(spark, sf).filter(F.col("key").cast("long") % 10 == 0).select(broken.alias("value")).write.option("compression", "gzip").text(f"{path}/broken")
    return described(annotated.read_bioc(spark, f"{path}/*", silver))


BIOC = f"""{SPANS}, r AS (SELECT a.k, string_agg(a.code || '-' || b.code, ',' ORDER BY a.pos) AS relations FROM s a JOIN s b ON b.k = a.k AND b.pos = a.pos + 1 GROUP BY a.k)
SELECT pmid, title, abstract, entities, coalesce(relations, '') AS relations FROM d LEFT JOIN r ON CAST(k AS VARCHAR) = pmid"""


@query(BIOC)
def q72b_bioc_files(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus form: offsets move to the joined text, relations point at annotations."""
    return bioc(spark, sf, False)


@query(BIOC)
def q72c_bioc_silver(spark: SparkSession, sf: str) -> DataFrame:
    """The silver form: relations carry the codes themselves, and broken documents are skipped."""
    return bioc(spark, sf, True)
