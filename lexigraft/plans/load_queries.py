"""Windows over whole documents, keyed loads, files in order, and stamps of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import streaming
from ..operators import hierarchy as H
from ..operators import warehouse, windows
from ..sources import documents as files
from .annotation_queries import ENTITIES, MAPPED, documents, targets
from .base import query, table
from .mapping_queries import BEST


def folder(spark: SparkSession, name: str) -> str:
    return f"{H.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- pieces and windows: the vocabulary is the documents' words cut at every third letter -------------------

SIZE, OVERLAP = 128, 32
PIECES = """w AS (SELECT doc_id AS doc, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS word FROM documents),
s AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w),
p AS (SELECT doc, word, start, text, unnest(range(0, length(text), 3)) AS lo FROM s WHERE length(text) > 0),
n AS (SELECT doc, count(*) AS n FROM p GROUP BY doc)"""
#: Windows of a document of n pieces: begun every 96 pieces, none of which lies inside the one before it.
CUT = f"v AS (SELECT doc, n, unnest(range(0, greatest(1, CAST(ceil((n - {OVERLAP}) / {SIZE - OVERLAP}.0) AS BIGINT)))) AS win FROM n)"


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, texts): the words of each document; the rows of an id that several have are one document."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.split("text", " ", -1).alias("texts"))
    again = H.settled(rows.groupBy("doc").count().filter("count > 1").select(F.col("doc").alias("_doc")))
    same = F.col("doc").eqNullSafe(F.col("_doc"))
    several = rows.join(again, same, "left_semi").groupBy("doc").agg(F.flatten(F.sort_array(F.collect_list("texts"))).alias("texts"))
    return rows.join(again, same, "left_anti").union(several)


def cut_windows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    chunk = F.transform(F.sequence(F.lit(0), F.char_length("text") - 1, F.lit(3)), lambda i: F.concat(F.when(i == 0, "").otherwise(windows.INNER), F.substring("text", i + 1, F.lit(3))))
    known = docs.select(F.explode("texts").alias("text")).filter("text <> ''").distinct().select(F.explode(chunk).alias("piece")).distinct()
    return windows.document_windows(docs, H.settled(known), SIZE, OVERLAP)


@query(f"WITH {PIECES}, {CUT} SELECT doc, win AS \"window\", CAST(least({SIZE}, n - win * {SIZE - OVERLAP}) AS INTEGER) AS pieces FROM v")
def q73_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping windows of whole documents and their lengths."""
    return cut_windows(spark, texts(spark, sf)).select("doc", "window", F.size("pieces").alias("pieces"))


@query(f"""WITH {PIECES}, {CUT}, l AS (SELECT least({SIZE}, n - win * {SIZE - OVERLAP}) AS len FROM v)
SELECT CAST(ceil(len / 32.0) AS BIGINT) AS bucket, count(*) AS windows, CAST(sum(len) AS BIGINT) AS pieces, true AS within FROM l GROUP BY 1""")
def q73b_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of at most 16 windows of alike lengths; padding stays under a bucket's width."""
    rows = cut_windows(spark, texts(spark, sf)).select("doc", "window", F.size("pieces").alias("pieces"))
    rows = windows.batches(rows, 16, 32, F.col("pieces"))
    per = rows.groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.sum("pieces").alias("pieces"), F.max("padding").alias("padding"))
    return per.groupBy("bucket").agg(F.sum("n").alias("windows"), F.sum("pieces").alias("pieces"), (F.max("padding") < 32).alias("padded"), (F.max("n") <= 16).alias("sized")).select("bucket", "windows", "pieces", (F.col("padded") & F.col("sized")).alias("within"))


@query(f"""WITH {PIECES}, b AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS text FROM benchmark)
SELECT doc, word, CAST(start AS BIGINT) AS "from", CAST(start + length(text) AS BIGINT) AS "to" FROM s JOIN b USING (text) WHERE length(text) > 0""")
def q73c_spans_of_windows(spark: SparkSession, sf: str) -> DataFrame:
    """All words of the benchmark in whole documents come back from the windows that hold them."""
    docs = texts(spark, sf)
    found = cut_windows(spark, docs)
    known = H.settled(table(spark, sf, "benchmark").select(F.explode(F.split("text", " ", -1)).alias("text")).filter("text <> ''").distinct())
    many, longest = known.agg(F.count("*"), F.max(F.char_length("text"))).first()
    known = F.broadcast(known) if many <= windows.VOCABULARY else known
    spans = windows.document_words(docs).join(known, "text").select("doc", F.col("word").alias("span"), "start", (F.col("start") + F.char_length("text")).alias("end"))
    return windows.located(spans, found, longest).select("doc", F.col("span").cast("long").alias("word"), "from", "to")


# --- keyed loads --------------------------------------------------------------

CUSTOMERS = warehouse.Table("id bigint, name string, segment string", ("id",), ("id", "name"), {"segment": ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")})


def customers(spark: SparkSession, sf: str, mark: str = "") -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(mark)).alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("other").alias("extra"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name || '*' ELSE c_name END AS name, c_mktsegment AS segment FROM customer")
def q75_keyed_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the customers, then a third of them anew, then all, of whom those that are there keep their rows."""
    path = folder(spark, "table")
    warehouse.load(customers(spark, sf).filter("id % 2 = 0"), CUSTOMERS, path)
    warehouse.load(customers(spark, sf, "*").filter("id % 3 = 0"), CUSTOMERS, path, replace=True)
    warehouse.load(customers(spark, sf), CUSTOMERS, path)
    return warehouse.read(spark, CUSTOMERS, path)


@query("SELECT c_custkey AS id, c_name || '+' AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 5 = 1")
def q75b_reset_and_reload(spark: SparkSession, sf: str) -> DataFrame:
    """A table that is emptied holds only what is loaded after that."""
    path = folder(spark, "table")
    warehouse.load(customers(spark, sf), CUSTOMERS, path)
    warehouse.reset(spark, CUSTOMERS, path)
    warehouse.load(customers(spark, sf, "+").filter("id % 5 = 1"), CUSTOMERS, path)
    return warehouse.read(spark, CUSTOMERS, path)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN replace(c_name, '#', chr(9)) || '\\t' END AS name, c_acctbal >= 0 AS flag, c_mktsegment || '|a"b\\' AS tags FROM customer""")
def q75c_copied_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the text form of bulk loads, loaded again with their types."""
    path = folder(spark, "copy")
    name = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.replace("c_name", F.lit("#"), F.lit("\t")), F.lit("\\t")))
    files.write_copy(table(spark, sf, "customer").select("c_custkey", name.alias("name"), (F.col("c_acctbal") >= 0).alias("flag"), F.array("c_mktsegment", F.lit('a"b\\')).alias("tags")), path)
    return warehouse.read_copy(spark, path, "id bigint, name string, flag boolean, tags array<string>").withColumn("tags", F.array_join("tags", "|"))


#: Mapping files at least, and rows of a file, about: a file is sorted by one task.
FILES, FILE_ROWS = 5, 1_000_000


@query("""WITH r AS (SELECT CAST(l_partkey AS VARCHAR) AS code, l_orderkey * 10 + l_linenumber AS place, CAST(l_suppkey AS VARCHAR) AS target_id FROM lineitem)
SELECT code, max_by(target_id, place) AS target_id FROM r GROUP BY code""")
def q60d_mapping_files(spark: SparkSession, sf: str) -> DataFrame:
    """Mappings in a folder of unequal files: of a code's rows the last one counts, files in the order of their names."""
    path = folder(spark, "mapping")
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = table(spark, sf, "lineitem").withColumn("place", place)
    rows = lines.repartitionByRange(max(FILES, lines.count() // FILE_ROWS), F.sqrt("place")).sortWithinPartitions("place")
    rows.select(F.col("l_partkey").cast("string").alias("mesh_id"), F.col("l_suppkey").cast("string").alias("snomed_id"), F.lit("0.5").alias("confidence"), F.lit("true").alias("snomed_active")).write.option("header", "true").csv(path)
    return files.read_mapping(spark, path).select("code", "target_id")


# --- a stream ------------------------------------------------------------------


@query(f"""{BEST.rstrip()}, {ENTITIES}, {MAPPED}
SELECT pmid, string_agg(CASE WHEN outside THEN '-' ELSE coalesce(target_id, '-') END, ',' ORDER BY pos) AS targets FROM e LEFT JOIN m USING (code) GROUP BY pmid""")
def q74_stamped_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of three folders, a batch each, stamped as they come; the stream is stopped after two and started again."""
    path = folder(spark, "stream")
    docs, mapped = H.settled(documents(spark, sf)), H.settled(targets(spark, sf))
    many = max(docs.rdd.getNumPartitions(), 1)  # files that a part is written in, so that no task writes it whole
    for part in range(3):
        files.write_documents(docs.filter(F.pmod(F.xxhash64("pmid"), F.lit(3)) == part), f"{path}/in/{part}")
        if part:
            streaming.stamp_stream(streaming.document_stream(spark, f"{path}/in/*", many), mapped, f"{path}/out", f"{path}/state").awaitTermination()
    found = spark.read.parquet(f"{path}/out")
    return found.select("pmid", F.array_join(F.transform("entities", lambda e: F.coalesce(e["mapped_id"], F.lit("-"))), ",").alias("targets"))
