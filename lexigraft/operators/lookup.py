"""Values of a table for the keys that a document holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(docs: DataFrame, keys: Column, table: DataFrame, name: str) -> DataFrame:
    """docs with a column `name`: entries (key, value) of table (key string, value) for the keys (an array<string>) of each document.

    Keys without a value have no entry; a document without any has an empty array.
    Documents are told apart by 128 bits of hash of all their columns, and equal
    ones are counted, so they need no key and may come in any order each time that
    they are read. The keys are joined one by one and a document's entries brought
    together again in one shuffle, on which only its first row carries the document.
    Documents without keys are dealt out like all others.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    ident = F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
    rows = docs.select(ident.alias("_id"), F.struct(*columns).alias("_row"), F.posexplode_outer(F.array_distinct(keys)).alias("_pos", "_key"))
    none = F.concat(F.lit("\u0000"), F.col("_id.a").cast("string"))  # a key of its own, so that those without one don't meet
    rows = rows.select("_id", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_row")).alias("_row"), F.coalesce("_key", none).alias("_key"))
    joined = rows.join(table.select(F.col("key").alias("_key"), F.col("value").alias("_value")), "_key", "left")
    entry = F.when(F.col("_value").isNotNull(), F.struct(F.col("_key").alias("key"), F.col("_value").alias("value")))
    out = joined.groupBy("_id").agg(F.first("_row", ignorenulls=True).alias("_row"), F.count("_row").alias("_n"), F.collect_list(entry).alias("_found"))
    found = F.when(F.col("_n") > 1, F.array_distinct("_found")).otherwise(F.col("_found"))
    out = out.select("_row", found.alias("_found"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
    return out.select("_row.*", F.col("_found").alias(name))
