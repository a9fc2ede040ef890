"""Footprints, semi-joins and the set-cover sample of documents.

The greedy cover goes through documents from rich to poor and takes one that
still helps a concept. Which concepts it helps depends on all before it, so it
is sequential; a concept that is full never needs looking at again, and only
the first documents of each concept can matter: a document helps concept c only
if fewer than `target` documents before it with c were taken, and every one of
the first `target` documents with c is taken. So a document is taken in the
first phase exactly if it is among the first `target` of one of its concepts,
which a window decides for all documents at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C


def footprint(mapped: DataFrame, least: float = C.FOOTPRINT_CONFIDENCE) -> DataFrame:
    """(code, semantic_class) of verified, certain codes; classes is a comma-joined list."""
    rows = mapped.filter((F.col("confidence") >= least) & F.col("target_active"))
    return rows.select("code", F.explode(F.split("classes", ",")).alias("semantic_class")).filter(F.col("semantic_class").isin("chemical", "disease"))


def in_domain(mentions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pmid, code, semantic_class) of documents that hold a wanted code of both classes."""
    rows = mentions.join(wanted, ["code", "semantic_class"], "left_semi").distinct()
    both = rows.groupBy("pmid").agg(F.count_distinct("semantic_class").alias("n")).filter("n = 2")
    return rows.join(both.select("pmid"), "pmid", "left_semi")


def set_cover(rows: DataFrame, size: int = C.SAMPLE_SIZE, target: int = C.COVERAGE) -> DataFrame:
    """(pmid, phase) of the sample of rows (pmid, code): phase 1 covers, phase 2 fills up by richness.

    Documents go by richness (codes, both classes counted), then pmid. All of
    phase 1 come before phase 2; the first `size` are kept.
    """
    rows = rows.distinct()
    rich = rows.groupBy("pmid").agg(F.count("*").alias("richness"))
    # only a concept's first `target` documents matter, so each task cuts its own before they meet
    place = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("richness"), "pmid"))
    covering = rows.join(rich, "pmid").withColumn("_place", place).filter(F.col("_place") <= target).select("pmid").distinct()
    phased = rich.join(covering.withColumn("_covers", F.lit(1)), "pmid", "left").withColumn("phase", F.when(F.col("_covers") == 1, 1).otherwise(2))
    return phased.orderBy("phase", F.desc("richness"), "pmid").limit(size).select("pmid", "phase", "richness")


def coverage_stats(rows: DataFrame, sample: DataFrame, target: int = C.COVERAGE) -> DataFrame:
    """One row: documents taken, concepts in the pool, and those covered once and up to the target."""
    taken = sample.select("pmid").withColumn("_in", F.lit(1))
    per = rows.distinct().join(taken, "pmid", "left").groupBy("code").agg(F.coalesce(F.sum("_in"), F.lit(0)).alias("n"))
    return per.agg(F.count("*").alias("concepts"), F.count_if(F.col("n") >= 1).alias("covered"), F.count_if(F.col("n") >= target).alias("at_target"))
