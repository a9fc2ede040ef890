"""Durable intermediate tables and connected components.

Every intermediate result is a Parquet table in the folder that the cluster
names in ``spark.checkpoint.dir``; all executors see it, so a lost executor
costs a re-read and never a rerun of the whole job.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in a plain local session."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexigraft-"))
    return context.getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a DataFrame once to the shared folder and go on from the files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list (a long, b long).

    Returns (node, label), label being the smallest node reachable. Each round
    takes the smallest label over a node's neighbours and then jumps to that
    label's label, so long chains halve; the rows of a round are the nodes.
    No edges give no rows; loops and repeated edges change nothing.
    """
    both = materialise(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges"
    )
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels"
    )
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        stepped = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = materialise(
            stepped.join(jump, "label").select(
                "node", F.least("label", "root").alias("label"), (F.least("label", "root") < F.col("was")).alias("moved")
            ),
            "labels",
        )
        if labels.filter("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
    raise RuntimeError("components did not settle; raise max_rounds")
