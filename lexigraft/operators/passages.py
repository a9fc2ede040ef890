"""Running offsets of passages within a joined text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def passage_offsets(rows: DataFrame, group: str, order: str, text: str, gap: int = 1) -> DataFrame:
    """Add start: the length of all texts before in the group, with a gap after each."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.char_length(F.coalesce(F.col(text), F.lit(""))) + gap).over(before), F.lit(0)))
