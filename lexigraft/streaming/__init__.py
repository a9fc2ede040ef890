"""Streaming forms of operators that need no more than a row, a static table or a counter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import stamp_concepts, stamp_relations
from ..schemas import DOCUMENT
from ..sources.annotated import pubtator_blocks


def annotated_stream(lines: DataFrame) -> DataFrame:
    """Raw documents of a stream of PubTator blocks (value)."""
    return pubtator_blocks(lines)


def stamped_stream(docs: DataFrame, table: DataFrame) -> DataFrame:
    """Stamp relations in a stream of documents; the relation table is static."""
    return stamp_relations(docs, table)


def mention_counts(mentions: DataFrame, *keys: str) -> DataFrame:
    """Running counts of a stream, for output mode complete or update."""
    return mentions.groupBy(*keys).agg(F.count("*").alias("frequency"))


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by tumbling window and key; rows later than `late` are dropped, and windows close then."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def distinct_documents(docs: DataFrame, time: str, late: str) -> DataFrame:
    """The first row of each pmid within the time that late rows may take."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark(["pmid"])


def document_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream of documents (schemas.DOCUMENT) in JSON lines, so many files a batch."""
    return spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files).json(path)


def stamp_stream(docs: DataFrame, mapped: DataFrame, path: str, checkpoint: str, **trigger: str | bool) -> StreamingQuery:
    """Stamp a stream of documents with the targets of mapped (code, target_id, confidence, target_active), a Parquet folder for each batch.

    A batch is stamped as a whole by stamp_concepts, so nothing is kept from batch to
    batch but the place in the input. A batch that is run again after a failure
    writes over its own folder, so each document comes out once.
    """

    def write(batch: DataFrame, number: int) -> None:
        stamp_concepts(batch, mapped).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stamped_mentions(mentions: DataFrame, mapped: DataFrame, time: str, late: str) -> DataFrame:
    """A stream of mentions (code, ...) with target_id, joined row by row with a static table, repeats within the lateness dropped."""
    static = mapped.select("code", "target_id")
    return mentions.withWatermark(time, late).dropDuplicatesWithinWatermark(["doc", "pos"]).join(static, "code", "left")
