"""Pooled spans and their cross-entropies as metrics over rows: what a head would score, without training it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a document that are summed together.
BLOCK = 4_096


def pool_spans(tokens: DataFrame, spans: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc, span, vector): the mean of the token vectors of each span (doc, span, start, end), end excluded.

    tokens are (doc, pos, vector array<double>) of one length. A span without
    positions counts as its first token. Positions without a token add nothing; a
    span without any token has no row. Spans may overlap and be of any length:
    documents are cut into blocks of positions, each block's vectors are summed up
    once, and a span takes the difference of two sums from every block that it meets.
    """
    doc = tokens.schema["doc"].dataType.simpleString()
    at = lambda c: F.floor(F.col(c) / block)
    own = tokens.select("doc", F.col("pos").cast("long").alias("pos"), "vector", at("pos").alias("block")).filter("vector is not null")
    last = F.greatest(F.col("end").cast("long") - 1, F.col("start").cast("long"))
    cut = spans.select("doc", F.col("span").cast("long").alias("span"), F.col("start").cast("long").alias("start"), last.alias("last"))
    cut = cut.withColumn("block", F.explode(F.sequence(at("start"), at("last"))))

    def sums(key: tuple, tokens: pa.Table, spans: pa.Table) -> pa.Table:
        names = ["doc", "span", "total", "n"]
        if not tokens.num_rows or not spans.num_rows:
            return pa.table({"doc": spans["doc"].slice(0, 0), "span": pa.array([], pa.int64()), "total": pa.array([], pa.list_(pa.float64())), "n": pa.array([], pa.int64())})
        tokens = tokens.sort_by("pos")
        places, vectors = tokens["pos"].to_numpy(), tokens["vector"].combine_chunks()
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(tokens.num_rows, -1)
        total = np.concatenate([np.zeros((1, matrix.shape[1])), np.cumsum(matrix, axis=0)])
        lo, hi = np.searchsorted(places, spans["start"].to_numpy(), "left"), np.searchsorted(places, spans["last"].to_numpy(), "right")
        good = np.flatnonzero(hi > lo)
        part = total[hi[good]] - total[lo[good]]
        cuts = pa.array(np.arange(0, part.size + 1, part.shape[1], dtype=np.int32)[: len(good) + 1])
        return pa.table([spans["doc"].take(pa.array(good)), spans["span"].take(pa.array(good)), pa.ListArray.from_arrays(cuts, pa.array(part.ravel())), pa.array((hi - lo)[good])], names=names)

    parts = own.groupBy("doc", "block").cogroup(cut.groupBy("doc", "block")).applyInArrow(sums, f"doc {doc}, span long, total array<double>, n long")
    # a span of several blocks has several parts; their sums are added place by place
    whole = parts.groupBy("doc", "span").agg(F.collect_list("total").alias("parts"), F.sum("n").alias("n"))
    total = F.when(F.size("parts") == 1, F.get("parts", F.lit(0))).otherwise(
        F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    )
    return whole.select("doc", "span", F.transform(total, lambda x: x / F.col("n")).alias("vector"))


def class_logits(rows: DataFrame, classes: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(doc, span, label, logit): the cosine of each pooled vector with each class vector (label, vector), by the temperature.

    classes are few, a row for each label of the task, and are broadcast. A zero vector has logit 0 everywhere.
    """
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    both = rows.join(F.broadcast(classes.select("label", F.col("vector").alias("_c"))))
    dot = F.aggregate(F.zip_with("vector", "_c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    cosine = F.coalesce(dot / F.nullif(size(F.col("vector")) * size(F.col("_c")), F.lit(0.0)), F.lit(0.0))
    return both.select("doc", "span", "label", (cosine / max(temperature, 1e-6)).alias("logit"))


def cross_entropy(logits: DataFrame, targets: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(doc, span, loss, weight, right): soft cross-entropy of each row's logits (doc, span, label, logit).

    targets (doc, span, label, prob) are made to sum to 1 over the labels that have
    a logit; rows without such mass are left out. weights (doc, span, weight) are 1
    where there is none. right: whether the likeliest label, of equals the first, is that of most mass.
    """
    keys = ["doc", "span"]
    joined = logits.join(targets.groupBy(*keys, "label").agg(F.sum("prob").alias("prob")), [*keys, "label"], "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))
    top = joined.groupBy(*keys).agg(F.max("logit").alias("_top"), F.sum("prob").alias("_mass")).filter("_mass > 0")
    rows = joined.join(top, keys)
    first = lambda value: F.min_by("label", F.struct((-F.col(value)).alias("v"), "label"))
    found = rows.groupBy(*keys, "_top", "_mass").agg(F.sum(F.exp(F.col("logit") - F.col("_top"))).alias("_sum"), F.sum(F.col("prob") * F.col("logit")).alias("_hit"), (first("logit") == first("prob")).alias("right"))
    loss = F.col("_top") + F.log("_sum") - F.col("_hit") / F.col("_mass")
    found = found.select(*keys, loss.alias("loss"), "right")
    found = found.join(weights.select(*keys, "weight"), keys, "left") if weights is not None else found.withColumn("weight", F.lit(1.0))
    return found.select(*keys, "loss", F.coalesce("weight", F.lit(1.0)).alias("weight"), "right")


def mean_loss(rows: DataFrame) -> DataFrame:
    """One row of cross_entropy() rows: their number, the mean of weight times loss, and the share of right ones."""
    return rows.agg(F.count("*").alias("spans"), F.avg(F.col("weight") * F.col("loss")).alias("loss"), F.avg(F.col("right").cast("double")).alias("accuracy"))
