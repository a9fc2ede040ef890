"""Bulk annotations and synthesis bound to the given tables: line items are bulk relations between parts and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import hashed_ngrams
from ..operators import documents as D
from ..operators import hierarchy as H
from ..operators import silver, soft
from .base import query, table
from .document_queries import GRAMS
from .graph_queries import LIN, NATIONS, REGIONS, SUPPLIERS, WITH, edges, members
from .mapping_queries import BEST, best

BULK = """bulk AS (SELECT CAST(l_orderkey AS VARCHAR) AS pmid, CASE l_returnflag WHEN 'A' THEN 'treat' WHEN 'R' THEN 'cause' ELSE 'compare' END AS relation,
  CAST(l_partkey AS VARCHAR) AS subject, CAST(l_suppkey AS VARCHAR) AS object FROM lineitem
  WHERE l_quantity > 5 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P'))"""
LABEL = "CASE relation WHEN 'treat' THEN 'treats' WHEN 'cause' THEN 'causes' ELSE 'associated-with' END"


def bulk(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    relation = F.when(F.col("l_returnflag") == "A", "treat").when(F.col("l_returnflag") == "R", "cause").otherwise("compare")
    object_ = F.concat(F.when(F.col("l_quantity") > 5, "Disease|").otherwise("Gene|"), F.col("l_suppkey").cast("string"))
    rows = lines.select(F.col("l_orderkey").cast("string").alias("pmid"), relation.alias("relation"), F.concat(F.lit("Chemical|MESH:"), F.col("l_partkey").cast("string")).alias("subject"), object_.alias("object"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))
    gold = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").cast("string").alias("pmid"))
    return silver.bulk_relations(rows, gold, None)


@query(f"WITH {BULK} SELECT pmid, relation, subject, object FROM bulk")
def q47_bulk_relations(spark: SparkSession, sf: str) -> DataFrame:
    return bulk(spark, sf).select("pmid", "relation", "subject", "object")


@query(BEST.rstrip() + f""", {BULK}, n AS (SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name FROM part), m AS (SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name FROM supplier),
t AS (SELECT CAST(code AS VARCHAR) AS code, CAST(sid AS VARCHAR) AS target, conf FROM best), r AS (SELECT bulk.*, {LABEL} AS label FROM bulk)
SELECT pmid, n.name || ' ' || label || ' ' || m.name AS text, CAST(length(n.name) + length(label) + 2 AS INTEGER) AS object_start, t.target AS subject_target, round(t.conf * 0.4, 6) AS subject_confidence, label
FROM r JOIN n ON subject = n.code JOIN m ON object = m.code LEFT JOIN t ON subject = t.code""")
def q47b_bulk_documents(spark: SparkSession, sf: str) -> DataFrame:
    relations = H.settled(bulk(spark, sf))  # the documents and both kinds of mentions read it
    part, supplier = table(spark, sf, "part"), table(spark, sf, "supplier")
    named = part.select(F.col("p_partkey").cast("string").alias("subject"), F.col("p_name").alias("subject_text"))
    other = supplier.select(F.col("s_suppkey").cast("string").alias("object"), F.col("s_name").alias("object_text"))
    mentions = relations.select("pmid", "subject").distinct().join(named, "subject").select("pmid", F.concat(F.lit("MESH:"), "subject").alias("code"), F.concat("subject_text", F.lit("|other")).alias("mentions"), F.lit(0).alias("ord"))
    mentions_o = relations.select("pmid", "object").distinct().join(other, "object").select("pmid", F.concat(F.lit("x"), "object").alias("object"), F.col("object_text").alias("mentions"), F.lit(0).alias("ord"))
    # parts and suppliers share numbers, so suppliers' codes get a letter
    relations = relations.withColumn("object", F.concat(F.lit("x"), "object"))
    rows = mentions.unionByName(mentions_o.withColumnRenamed("object", "code"))
    mapped = best(spark, sf).select(F.col("code").cast("string").alias("code"), F.col("sid").cast("string").alias("target_id"), F.col("conf").alias("confidence"))
    docs = silver.bulk_documents(relations, H.settled(silver.bulk_mentions(rows, relations)), mapped, None)  # named twice
    first, second = F.element_at("entities", 1), F.element_at("entities", 2)
    return docs.select("pmid", "text", second["span_start"].alias("object_start"), first["mapped_id"].alias("subject_target"), F.round(first["mapping_confidence"], 6).alias("subject_confidence"), F.element_at("relations", 1)["target_relation"].alias("label"))


ANCHORS = dict(zip(("r0", "r1", "r2", "r3", "r4"), ("finding", "substance", "product", "event", "procedure"), strict=True))
KINDS = ", ".join(f"('{r}', '{k}')" for r, k in ANCHORS.items())


def triples_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triples of suppliers and customers that an order brings together, their terms, and what lies under the scope's anchors."""
    rows = edges(spark, sf)
    start = F.element_at(F.create_map(*(F.lit(x) for r, k in ANCHORS.items() for x in (r, C.SCOPE_ANCHORS[k]))), F.col("start"))
    below = H.closure(rows, members(spark, sf, REGIONS), up=False).select(start.alias("start"), "reached")
    kind = F.when(F.col("l_returnflag") == "A", "246075003").when(F.col("l_returnflag") == "N", "42752001").otherwise("255234002")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    triples = table(spark, sf, "lineitem").join(orders, "l_orderkey").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("destination_id"), kind.alias("type_id"), F.lit("1").alias("active"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord")
    )
    terms = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat("s_name", F.lit(" (supplier)")).alias("term"))
    terms = terms.union(table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat("c_name", F.lit(" (customer)"))))
    return triples, terms, below


@query(WITH + f""", k(region, kind) AS (VALUES {KINDS}), b AS (SELECT DISTINCT start AS id, kind FROM up JOIN k ON reached = region),
t AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS s, 'c' || CAST(o_custkey AS VARCHAR) AS c, CASE l_returnflag WHEN 'A' THEN 'causative-agent' WHEN 'N' THEN 'due-to' ELSE 'after' END AS label
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT label, CASE WHEN y.kind IN ('substance', 'product') THEN 'chemical' ELSE 'disease' END AS object_class, count(*) AS documents FROM t JOIN b x ON s = x.id AND x.kind = 'finding' JOIN b y ON c = y.id
WHERE CASE WHEN label = 'causative-agent' THEN y.kind IN ('substance', 'product') ELSE y.kind IN ('finding', 'event', 'procedure') END GROUP BY ALL""")
def q48_synthesis(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.synthesise(*triples_of(spark, sf), least_causative=0)
    return docs.groupBy(F.element_at("relations", 1)["target_relation"].alias("label"), F.element_at("entities", 2)["semantic_class"].alias("object_class")).agg(F.count("*").alias("documents"))


NGRAM = GRAMS.replace("text[", "name[")


@query(WITH + LIN + f"""s AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS start FROM supplier),
ring AS (SELECT start, start AS id, 0 AS hops, 0 AS ring, 0 AS o1, 0 AS o2 FROM s
  UNION ALL SELECT start, parent, 1, 1, ord, 0 FROM s JOIN edges ON child = start
  UNION ALL SELECT start, b.parent, 2, 2, a.ord, b.ord FROM s JOIN edges a ON a.child = start JOIN edges b ON b.child = a.parent
  UNION ALL SELECT start, b.child, 2, 5, a.ord, b.ord FROM s JOIN edges a ON a.child = start JOIN edges b ON b.parent = a.parent),
f AS (SELECT * FROM ring QUALIFY row_number() OVER (PARTITION BY start, id ORDER BY ring, o1, o2) = 1),
near AS (SELECT start, id, hops FROM f QUALIFY row_number() OVER (PARTITION BY start ORDER BY ring, o1, o2, id) <= 30),
lin AS (SELECT near.start AS a, near.id AS b, CASE WHEN near.start = near.id THEN 1.0 WHEN max(i.ic) + max(j.ic) <= 0 THEN 0.0 ELSE coalesce(2 * max(t.ic) / (max(i.ic) + max(j.ic)), 0.0) END AS lin
  FROM near JOIN ic i ON i.id = near.start JOIN ic j ON j.id = near.id LEFT JOIN (SELECT start, reached FROM up UNION SELECT id, id FROM nodes) x ON x.start = near.start
  LEFT JOIN (SELECT start, reached FROM up UNION SELECT id, id FROM nodes) y ON y.start = near.id AND y.reached = x.reached LEFT JOIN ic t ON t.id = y.reached GROUP BY near.start, near.id),
names AS (SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS raw FROM part UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), n_name FROM nation
  UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), r_name FROM region UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), c_name FROM customer),
piece AS (SELECT key, ' ' || lower(raw) || ' ' AS name, unnest(generate_series(1, length(raw))) AS i FROM names),
v AS (SELECT key, CAST({NGRAM} AS INTEGER) AS dim, count(*) AS n FROM piece GROUP BY ALL), size AS (SELECT key, sqrt(sum(n * n)) AS size FROM v GROUP BY key),
ev AS (SELECT l_partkey code, l_suppkey sid, 1 tier, CAST(0.95 AS DOUBLE) conf FROM lineitem WHERE l_returnflag='A' AND l_quantity>=46
  {BEST[BEST.index("UNION SELECT l_partkey, l_suppkey, 2"):].strip()},
cand AS (SELECT CAST(code AS VARCHAR) AS code, near.id AS target_id, near.start AS main, near.hops FROM best JOIN near ON near.start = 's' || CAST(sid AS VARCHAR)),
dots AS (SELECT c.code, c.target_id, sum(x.n * y.n) AS dot FROM cand c JOIN v x ON x.key = c.code JOIN v y ON y.key = c.target_id AND y.dim = x.dim GROUP BY ALL),
sim AS (SELECT cand.code, cand.target_id, cand.hops, (coalesce(dot / (p.size * q.size), 0) + 1.0 / (1 + cand.hops) + coalesce(lin, 0)) / 3 AS sim FROM cand LEFT JOIN dots USING (code, target_id)
  LEFT JOIN size p ON p.key = cand.code LEFT JOIN size q ON q.key = cand.target_id LEFT JOIN lin ON a = main AND b = cand.target_id),
w AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY code)) / 0.05) AS w FROM sim)
SELECT code, target_id, hops, round_even(w / sum(w) OVER (PARTITION BY code), 6) AS prob FROM w""")
def q49_soft_map(spark: SparkSession, sf: str) -> DataFrame:
    """Distributions of each mapped part over its target's neighbourhood: names, hops and information content in equal shares."""
    rows = H.settled(edges(spark, sf))
    mapped = best(spark, sf).select(F.col("code").cast("string").alias("code"), F.concat(F.lit("s"), F.col("sid").cast("string")).alias("primary"))
    near = H.settled(H.neighbourhood(rows, members(spark, sf, SUPPLIERS)))  # three plans read it
    named = lambda t, p, key, name: table(spark, sf, t).select(F.concat(F.lit(p), F.col(key).cast("string")).alias("key"), F.col(name).alias("name"))
    names = named("part", "", "p_partkey", "p_name").union(named("supplier", "s", "s_suppkey", "s_name")).union(named("customer", "c", "c_custkey", "c_name")).union(named("nation", "n", "n_nationkey", "n_name")).union(named("region", "r", "r_regionkey", "r_name"))
    ids = near.select("id").distinct()
    pairs = near.select(F.col("start").alias("a"), F.col("id").alias("b"))
    size = H.nodes(rows.select(F.col("child").alias("id"), F.lit("1").alias("active")), rows).count()
    ic = H.settled(H.information_content(H.descendant_counts(rows, ids.union(members(spark, sf, NATIONS, REGIONS)).distinct()), size))
    lin = H.settled(H.lin_similarity(pairs, H.settled(H.closure(rows, ids)), ic))
    targets = near.select(F.col("start").alias("primary"), F.col("id").alias("target_id"), "hops")
    return soft.soft_map(mapped, targets, names, lambda name: hashed_ngrams(name, 3, 32), lin).select("code", "target_id", "hops", "prob")
