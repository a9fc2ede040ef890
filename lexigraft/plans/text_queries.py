"""Full-text search, vector store and search, pooled losses: whole texts and all vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fulltext, losses, soft
from ..operators import hierarchy as H
from ..sources import vectors
from .base import query, table

WORDS = r"""lower_(id, ws) AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}]+') FROM documents),
asked(query, qs) AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\p{L}\p{N}]+') FROM benchmark)"""


def index(spark: SparkSession, sf: str) -> fulltext.Index:
    return fulltext.build(table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text"))


def asked(spark: SparkSession, sf: str, some: int | None = None) -> DataFrame:
    """The benchmark's items as queries, or their first words."""
    text = F.col("text") if some is None else F.array_join(F.slice(fulltext.words(F.col("text")), 1, some), " ")
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), text.alias("text"))


@query(f"""WITH {WORDS}, q AS (SELECT query, qs[1:4] AS qs FROM asked WHERE len(qs) > 0),
s AS (SELECT id, ws, unnest(generate_series(1, len(ws))) AS i FROM lower_)
SELECT query, id AS doc, count(*) AS hits FROM s JOIN q ON ws[i] = qs[1] AND ws[i : i + len(qs) - 1] = qs GROUP BY ALL""")
def q69_phrase_search(spark: SparkSession, sf: str) -> DataFrame:
    """The first four words of each benchmark item, one after another in whole documents."""
    return fulltext.phrases(index(spark, sf), asked(spark, sf, 4))


@query(f"""WITH {WORDS}, n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM lower_),
t AS (SELECT id, len(ws) AS length, term, count(*) AS tf FROM (SELECT id, ws, unnest(ws) AS term FROM lower_) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1),
q AS (SELECT DISTINCT query, unnest(qs) AS term FROM asked),
s AS (SELECT query, id AS doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM q JOIN d USING (term) JOIN t USING (term) CROSS JOIN n GROUP BY ALL)
SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) AS INTEGER) AS rank, round(score, 4) AS score FROM s QUALIFY rank <= 10""")
def q69b_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return fulltext.ranked(index(spark, sf), asked(spark, sf)).select("query", "doc", F.col("rank").cast("int").alias("rank"), F.round("score", 4).alias("score"))


@query("SELECT vec_id AS id, len(embedding) AS dimension, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total FROM embeddings")
def q70_vector_store(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors, written as fixed-stride records and read again."""
    path = f"{H.shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vectors.write_vectors(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), path)
    found = vectors.read_vectors(spark, path)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return found.select("id", F.size("vector").cast("long").alias("dimension"), (F.round(total, 6) + F.lit(0.0)).alias("total"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id, r.vec_id AS other, list_cosine_similarity(q.e, r.e) AS sim FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0)
SELECT vec_id, other, round(sim, 4) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 6) DESC, other) <= 10""")
def q70b_store_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every twentieth vector, all read from the store."""
    path = f"{H.shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vectors.write_vectors(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), path)
    rows = vectors.read_vectors(spark, path)
    found = soft.nearest_rows(rows.filter("id % 20 = 0"), rows, 10)
    return found.select(F.col("query").alias("vec_id"), F.col("id").alias("other"), F.round("similarity", 4).alias("sim"))


#: Vectors are tokens, sixteen a document; spans begin at every third token and grow by the document; labels are classes, whose vectors are means.
POOLED = """v AS (SELECT vec_id // 16 AS doc, vec_id % 16 AS pos, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
x AS (SELECT doc, pos, label, unnest(e) AS x, generate_subscripts(e, 1) AS d FROM v),
c AS (SELECT label, d, avg(x) AS c FROM x GROUP BY ALL),
sp AS (SELECT doc, pos // 3 AS span, pos AS s, pos + doc % 5 AS z FROM v WHERE pos % 3 = 0),
p AS (SELECT sp.doc, span, d, avg(x) AS p FROM sp JOIN x ON x.doc = sp.doc AND pos >= s AND pos < greatest(z, s + 1) GROUP BY ALL),
l AS (SELECT doc, span, label, sum(p * c) / (sqrt(sum(p * p)) * sqrt(sum(c * c))) / 0.05 AS logit FROM p JOIN c USING (d) GROUP BY ALL),
g AS (SELECT sp.doc, span, label, count(*) AS n FROM sp JOIN v ON v.doc = sp.doc AND pos >= s AND pos < greatest(z, s + 1) GROUP BY ALL),
t AS (SELECT l.doc, l.span, l.label, logit, coalesce(n, 0) AS n FROM l LEFT JOIN g USING (doc, span, label)),
m AS (SELECT doc, span, max(logit) AS top, sum(n) AS mass FROM t GROUP BY ALL),
r AS (SELECT doc, span, max(top) + ln(sum(exp(logit - top))) - sum(n * logit) / max(mass) AS loss, arg_min(label, {'v': -round(logit, 9), 'l': label}) = arg_min(label, {'v': -n, 'l': label}) AS hit, 1.0 / (1 + span) AS weight FROM t JOIN m USING (doc, span) GROUP BY ALL)"""


def span_losses(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.expr("vec_id div 16").alias("doc"), (F.col("vec_id") % 16).alias("pos"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    spans = rows.filter("pos % 3 = 0").select("doc", F.expr("pos div 3").alias("span"), F.col("pos").alias("start"), (F.col("pos") + F.col("doc") % 5).alias("end"))
    dims = rows.select("label", F.posexplode("vector").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    classes = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vector"))
    logits = losses.class_logits(losses.pool_spans(rows, spans, block=8), classes)
    inside = spans.withColumn("pos", F.explode(F.sequence("start", F.greatest(F.col("end") - 1, F.col("start"))))).join(rows.select("doc", "pos", "label"), ["doc", "pos"])
    targets = inside.groupBy("doc", "span", "label").agg(F.count("*").cast("double").alias("prob"))
    return losses.cross_entropy(logits.withColumn("logit", F.round("logit", 9)), targets, spans.select("doc", "span", (1.0 / (1 + F.col("span"))).alias("weight")))


@query(f"WITH {POOLED} SELECT doc, span, round(loss, 5) AS loss, hit FROM r")
def q71_span_loss(spark: SparkSession, sf: str) -> DataFrame:
    """The soft cross-entropy of each pooled span against the labels of its tokens."""
    return span_losses(spark, sf).select("doc", "span", F.round("loss", 5).alias("loss"), F.col("right").alias("hit"))


@query(f"WITH {POOLED} SELECT count(*) AS spans, round(avg(weight * loss), 5) AS loss, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM r")
def q71b_mean_loss(spark: SparkSession, sf: str) -> DataFrame:
    found = losses.mean_loss(span_losses(spark, sf))
    return found.select("spans", F.round("loss", 5).alias("loss"), F.round("accuracy", 6).alias("accuracy"))
