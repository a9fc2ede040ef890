"""The corpus pipeline: toxicity, quality rules, near-dedup and packing over documents.

Each stage is (spark, docs, sf_dir) -> DataFrame. run() writes every stage as
Parquet into the shared folder and reads it again as the next one's documents.
Null or empty texts are neither toxic nor near copies; the quality stage drops
them as too short. Columns other than those of documents go along in the first
three stages, whatever their names: rows travel as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraft.llm import decision_list, hyperminhash, pow2_packing, toxicity
from lexigraft.llm.queries import fold, table, tokenizer
from lexigraft.llm.shared import new_path

#: Words of a shingle and percent of similarity for near copies.
SHINGLE, PERCENT = 5, 75


def as_rows(docs: DataFrame, *also: str | Column) -> DataFrame:
    """Each row as a struct `_row`, beside the columns that an operator reads."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), *also)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold(3) != 1))
    return model.score(as_rows(docs, "text"), ["_row"]).filter("predicted = 0").select("_row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the learned decision list."""
    rules = decision_list.fit(docs, table(spark, sf_dir, "labels"))
    return decision_list.judge(as_rows(docs, "text"), rules, ["_row"]).filter("kept").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies.

    A doc_id that several rows share goes only if none of them is kept; rows without a doc_id stay.
    """
    found = hyperminhash.near_duplicates(docs, SHINGLE, PERCENT)
    gone = found.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select(F.col("doc_id").alias("_gone"))
    own = as_rows(docs, F.col("doc_id").cast("long").alias("_id"))
    return own.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences: doc_id, start, length, ids (packed uint32), doc_tokens, sequence_id, offset."""
    return pow2_packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_dedup", drop_near_copies), ("packing", pack)]

#: Learned verdicts, near copies and tokenizer ids have no SQL; tests hold the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
