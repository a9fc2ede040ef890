"""Evaluation: spans, relations, concepts and solver runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ratio(part, whole):
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def _prf(df: DataFrame) -> DataFrame:
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    df = df.withColumns({"precision": precision, "recall": recall})
    total = F.col("precision") + F.col("recall")
    return df.withColumn("f1", F.when(total == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / F.nullif(total, F.lit(0.0))))


def span_f1(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row of micro precision, recall and F1 over the distinct keys of both sides."""
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(True))
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(True))
    joined = p.join(g, keys, "full_outer")
    counts = joined.agg(F.count_if(F.col("_p") & F.col("_g")).alias("tp"), F.count_if(F.col("_p") & F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull() & F.col("_g")).alias("fn"))
    return _prf(counts)


def macro_f1(rows: DataFrame, labels: list[str]) -> DataFrame:
    """One row: the mean F1 of `labels` over rows (predicted, gold); a label that never comes counts 0."""
    spark = rows.sparkSession
    counts = rows.groupBy("predicted", "gold").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(x,) for x in labels], "label string")
    joined = F.broadcast(wanted).join(counts, (F.col("label") == F.col("predicted")) | (F.col("label") == F.col("gold")), "left")
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    hit, given, true = F.col("predicted") == F.col("gold"), F.col("predicted") == F.col("label"), F.col("gold") == F.col("label")
    per = joined.groupBy("label").agg(n(hit).alias("tp"), n(given & ~hit).alias("fp"), n(true & ~hit).alias("fn"))
    return _prf(per).agg(F.avg("f1").alias("macro_f1"))


def concept_accuracy(predicted: DataFrame, soft_gold: DataFrame, above: DataFrame) -> DataFrame:
    """One row: rows, top1 and ancestor accuracy of predicted (doc, span, target_id).

    soft_gold is (doc, span, target_id, prob), whose likeliest target is true, of
    equals the smallest; above is (start, reached) of the true targets. Spans are
    matched by doc and span.
    """
    gold = soft_gold.groupBy("doc", "span").agg(F.max_by("target_id", F.struct("prob", F.lit(0))).alias("_any"), F.min_by("target_id", F.struct(-F.col("prob"), F.col("target_id"))).alias("gold"))
    joined = predicted.join(gold.select("doc", "span", "gold"), ["doc", "span"])
    up = above.select(F.col("start").alias("gold"), F.col("reached").alias("target_id")).distinct().withColumn("_up", F.lit(True))
    joined = joined.join(up, ["gold", "target_id"], "left")
    same = F.col("target_id") == F.col("gold")
    out = joined.agg(F.count("*").alias("rows"), F.count_if(same).alias("_top"), F.count_if(same | F.coalesce("_up", F.lit(False))).alias("_anc"))
    return out.select("rows", _ratio(F.col("_top"), F.col("rows")).alias("top1"), _ratio(F.col("_anc"), F.col("rows")).alias("ancestor_accuracy"))


def combined_metric(ner: float, norm: float, rel: float) -> float:
    """The development metric of the joint task."""
    return 0.4 * ner + 0.3 * norm + 0.3 * rel


def solver_summary(solved: DataFrame) -> DataFrame:
    """One row: solved and fallback documents, their share, overrides and mean milliseconds."""
    return solved.agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "sat").alias("sat"), F.count_if(F.col("status") == "fallback").alias("fallback"),
        F.coalesce(F.sum("overrides"), F.lit(0)).alias("overrides"), F.avg("elapsed_ms").alias("mean_ms"),
    ).withColumn("sat_rate", _ratio(F.col("sat"), F.col("documents")))
