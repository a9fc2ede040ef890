"""Documents as JSON lines, tables as CSV, summaries as JSON, and a cache keyed by its inputs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import copy_field
from ..schemas import DOCUMENT, SCHEMA_VERSION
from .order import place


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents from JSON lines in any depth of folders; blank lines are skipped and missing keys get their defaults."""
    df = spark.read.schema(DOCUMENT).option("recursiveFileLookup", "true").json(path).filter("pmid is not null")
    empty = lambda c: F.coalesce(c, F.lit(""))
    return df.select(
        "pmid", empty(F.col("corpus")).alias("corpus"), empty(F.col("split")).alias("split"), empty(F.col("title")).alias("title"), empty(F.col("abstract")).alias("abstract"), empty(F.col("text")).alias("text"),
        F.coalesce("entities", F.array().cast(df.schema["entities"].dataType)).alias("entities"), F.coalesce("relations", F.array().cast(df.schema["relations"].dataType)).alias("relations"),
        F.coalesce("schema_version", F.lit(SCHEMA_VERSION)).alias("schema_version"),
    )


def write_documents(docs: DataFrame, path: str) -> None:
    """One document a line, null fields kept as keys; files are gzipped, since most of a line is the same keys again and again."""
    docs.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def write_table(df: DataFrame, path: str, *order: str, one_file: bool = False) -> None:
    """CSV with a header, sorted; one_file is for reports that are small by nature."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", "true").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Each row as one JSON object."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_mapping(spark: SparkSession, path: str, skip_bad: bool = False) -> DataFrame:
    """(code, target_id, confidence, target_active) of a verified mapping as CSV with a header; rows without an id are dropped.

    An empty confidence is 0. One that is no number is 0 too, or its row is dropped with skip_bad. Of a code's rows the last one counts, files being read in the order of their paths.
    """
    rows = spark.read.option("header", "true").option("enforceSchema", "false").csv(path)
    rows = rows.withColumn("_place", place(rows))
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    value = F.when(text("confidence") == "", F.lit(0.0)).otherwise(text("confidence").try_cast("double"))
    own = rows.select(text("mesh_id").alias("code"), text("snomed_id").alias("target_id"), value.alias("confidence"), (F.lower(text("snomed_active")) == "true").alias("target_active"), "_place")
    own = own.filter("code <> '' and target_id <> ''")
    own = own.filter("confidence is not null") if skip_bad else own.fillna(0.0, ["confidence"])
    last = own.groupBy("code").agg(F.max_by(F.struct("target_id", "confidence", "target_active"), "_place").alias("m"))
    return last.select("code", "m.target_id", "m.confidence", "m.target_active")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Files that are one JSON value each; give the schema of large ones, else they are read twice."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def write_copy(df: DataFrame, path: str) -> None:
    """Rows in the tab-separated text form that databases load in bulk, a file per partition."""
    fields = [copy_field(F.col(f"`{c}`"), kind) for c, kind in df.dtypes]
    df.select(F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").text(path)


def signature(spark: SparkSession, paths: list[str]) -> str:
    """A digest of names, sizes and times of the files under the paths, on any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        for status in place.getFileSystem(conf).globStatus(place) or []:
            found.append((status.getPath().getName(), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()


def cached(spark: SparkSession, path: str, inputs: list[str], build: Callable[[], DataFrame], version: int = 1, force: bool = False) -> DataFrame:
    """A Parquet table at path/<signature>: read if its inputs are unchanged, else built and written.

    Another signature is another folder, so a reader never meets half a table.
    """
    where = f"{path.rstrip('/')}/v{version}-{signature(spark, inputs)}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
    if force or not done.getFileSystem(conf).exists(done):
        build().write.mode("overwrite").parquet(where)
    return spark.read.parquet(where)


def cached_tables(spark: SparkSession, path: str, inputs: list[str], build: Callable[[], dict[str, DataFrame]], names: tuple[str, ...], version: int = 1) -> dict[str, DataFrame]:
    """Tables that belong together, at path/<signature>/<name>: read if all of them are whole, else all built anew.

    A mark is written after the last table, so tables of a build that was broken off are never read.
    """
    where = f"{path.rstrip('/')}/v{version}-{signature(spark, inputs)}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{where}/_whole")
    store = done.getFileSystem(conf)
    if not store.exists(done):
        for name, df in build().items():
            df.write.mode("overwrite").parquet(f"{where}/{name}")
        store.create(done).close()
    return {name: spark.read.parquet(f"{where}/{name}") for name in names}


def first_match(spark: SparkSession, patterns: list[str]) -> str | None:
    """The first file, in order of the patterns and then of names, that exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for pattern in patterns:
        place = jvm.org.apache.hadoop.fs.Path(pattern)
        names = sorted(s.getPath().toString() for s in place.getFileSystem(conf).globStatus(place) or [])
        if names:
            return names[0]
    return None
