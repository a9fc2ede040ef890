"""Hierarchy, similarity and graph operators bound to region > nation > {customer, supplier} and to the vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..operators import kg, soft
from .base import query, table

EDGES = """
edges AS (
  SELECT 'c' || CAST(c_custkey AS VARCHAR) AS child, 'n' || CAST(c_nationkey AS VARCHAR) AS parent, c_custkey AS ord FROM customer
  UNION SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR), s_suppkey FROM supplier
  UNION SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), CAST(n_nationkey AS BIGINT) FROM nation
  UNION SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'root', CAST(r_regionkey AS BIGINT) FROM region)
"""
CLOSURE = "up AS (SELECT child AS start, parent AS reached, 1 AS hops FROM edges UNION ALL SELECT up.start, e.parent, up.hops + 1 FROM up JOIN edges e ON e.child = up.reached)"
WITH = f"WITH RECURSIVE {EDGES.strip()}, {CLOSURE}"


def edges(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = None
    for t, child, key, parent in (("customer", "c", "c_custkey", name("n", "c_nationkey")), ("supplier", "s", "s_suppkey", name("n", "s_nationkey")), ("nation", "n", "n_nationkey", name("r", "n_regionkey")), ("region", "r", "r_regionkey", F.lit("root"))):
        rows = table(spark, sf, t).select(name(child, key).alias("child"), parent.alias("parent"), F.col(key).cast("long").alias("ord"))
        out = rows if out is None else out.union(rows)
    return out.distinct()


def members(spark: SparkSession, sf: str, *tables: tuple[str, str, str]) -> DataFrame:
    out = None
    for t, prefix, key in tables:
        rows = table(spark, sf, t).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"))
        out = rows if out is None else out.union(rows)
    return out


CUSTOMERS, SUPPLIERS, NATIONS, REGIONS = ("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"), ("nation", "n", "n_nationkey"), ("region", "r", "r_regionkey")


@query(f"WITH {EDGES} SELECT id FROM (SELECT child AS id FROM edges UNION SELECT parent FROM edges)")
def q15_dag_nodes(spark: SparkSession, sf: str) -> DataFrame:
    concepts = members(spark, sf, NATIONS, REGIONS).withColumn("active", F.lit("1"))
    return H.nodes(concepts, edges(spark, sf))


@query(f"WITH {EDGES} SELECT child, parent FROM edges")
def q15b_dag_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = edges(spark, sf).select(F.col("child").alias("source_id"), F.col("parent").alias("destination_id"), F.lit("isa").alias("type_id"), F.lit("1").alias("active"), "ord")
    return H.edges(rows, is_a="isa").select("child", "parent")


@query(WITH + " SELECT start AS id, min(hops) AS depth FROM up WHERE reached = 'root' GROUP BY 1 UNION ALL SELECT 'root', 0")
def q16_depth(spark: SparkSession, sf: str) -> DataFrame:
    return H.depths(edges(spark, sf), "root")


@query(WITH + " SELECT start, reached, min(hops) AS hops FROM up WHERE start LIKE 'c%' GROUP BY ALL")
def q17_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return H.closure(edges(spark, sf), members(spark, sf, CUSTOMERS))


@query(WITH + """, anchors AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS id FROM nation UNION SELECT 'r' || CAST(r_regionkey AS VARCHAR) FROM region)
SELECT id, count(DISTINCT start) AS descendants FROM anchors LEFT JOIN up ON reached = id GROUP BY id""")
def q18_descendant_counts(spark: SparkSession, sf: str) -> DataFrame:
    return H.descendant_counts(edges(spark, sf), members(spark, sf, NATIONS, REGIONS))


@query(WITH + """, tops AS (SELECT child AS top FROM edges WHERE parent = 'root'),
m AS (SELECT start AS id, reached AS top FROM up WHERE reached IN (SELECT top FROM tops) UNION SELECT top, top FROM tops)
SELECT id, string_agg(top, ',' ORDER BY top) AS tops, min(top) AS semantic_type FROM m GROUP BY id""")
def q19_membership(spark: SparkSession, sf: str) -> DataFrame:
    return H.memberships(edges(spark, sf), "root").select("id", F.array_join("tops", ",").alias("tops"), "semantic_type")


LIN = """, nodes AS (SELECT child AS id FROM edges UNION SELECT parent FROM edges), n AS (SELECT count(*) AS size FROM nodes),
ic AS (SELECT id, -log2(CAST(count(DISTINCT start) + 1 AS DOUBLE) / max(size)) AS ic FROM nodes CROSS JOIN n LEFT JOIN up ON reached = id GROUP BY id),
"""


@query(WITH + LIN.rstrip().rstrip(",") + " SELECT id, round(ic, 6) + 0.0 AS ic FROM ic")
def q20_information_content(spark: SparkSession, sf: str) -> DataFrame:
    rows = edges(spark, sf)
    found = H.nodes(rows.select(F.col("child").alias("id"), F.lit("1").alias("active")), rows)
    return H.information_content(H.descendant_counts(rows, found), found.count()).select("id", (F.round("ic", 6) + F.lit(0.0)).alias("ic"))


@query(WITH + LIN + """
own AS (SELECT start, reached FROM up WHERE start[1] IN ('s', 'c') UNION SELECT id, id FROM nodes WHERE id[1] IN ('s', 'c')),
p AS (SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS a, 'c' || CAST(o_custkey AS VARCHAR) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
t AS (SELECT p.a, p.b, max(ic.ic) AS top FROM p JOIN own x ON x.start = p.a JOIN own y ON y.start = p.b AND y.reached = x.reached JOIN ic ON ic.id = x.reached GROUP BY ALL)
SELECT t.a, t.b, round(CASE WHEN i.ic + j.ic <= 0 THEN 0 ELSE 2 * top / (i.ic + j.ic) END, 6) + 0.0 AS lin FROM t JOIN ic i ON i.id = t.a JOIN ic j ON j.id = t.b""")
def q20b_lin_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The suppliers and customers that an order brings together."""
    rows = edges(spark, sf)
    found = H.nodes(rows.select(F.col("child").alias("id"), F.lit("1").alias("active")), rows)
    ic = H.information_content(H.descendant_counts(rows, found), found.count())
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("b"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"))
    count = lines.count()
    pairs = H.spread(H.spread(lines, count, "l_orderkey").join(orders, "l_orderkey").select("a", "b"), count, "a", "b").distinct()
    return H.lin_similarity(pairs, H.closure(rows, members(spark, sf, SUPPLIERS, CUSTOMERS)), ic).select("a", "b", (F.round("lin", 6) + F.lit(0.0)).alias("lin"))


NEAR = """, q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id, e.vec_id AS other, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS sim FROM q JOIN embeddings e ON q.vec_id <> e.vec_id),
k AS (SELECT vec_id, other, sim, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 6) DESC, other) AS rank FROM s)
"""


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of each query vector, queries being every twentieth."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    found = soft.nearest_rows(rows.filter("id % 20 = 0"), rows, 5)
    return found.select(F.col("query").alias("vec_id"), F.col("id").alias("other"), "similarity", "rank").withColumnRenamed("similarity", "sim")


@query("WITH a AS (SELECT 1)" + NEAR + "SELECT vec_id, other, CAST(rank AS INTEGER) AS rank, round(sim, 4) AS sim FROM k WHERE rank <= 5")
def q27_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(spark, sf).select("vec_id", "other", F.col("rank").cast("int").alias("rank"), F.round("sim", 4).alias("sim"))


@query("WITH a AS (SELECT 1)" + NEAR + """, t AS (SELECT vec_id, other, exp((sim - max(sim) OVER (PARTITION BY vec_id)) / 0.05) AS p FROM k WHERE rank <= 5)
SELECT vec_id, other, round(p / sum(p) OVER (PARTITION BY vec_id), 4) AS prob FROM t""")
def q28_softmax(spark: SparkSession, sf: str) -> DataFrame:
    return soft.softmax_rows(nearest(spark, sf), ["vec_id"], "sim").select("vec_id", "other", F.round("prob", 4).alias("prob"))


@query(f"""WITH {EDGES}, s AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS start FROM supplier),
r AS (SELECT start, start AS id, 0 AS hops, 0 AS ring, 0 AS o1, 0 AS o2 FROM s
  UNION ALL SELECT start, parent, 1, 1, ord, 0 FROM s JOIN edges ON child = start
  UNION ALL SELECT start, b.parent, 2, 2, a.ord, b.ord FROM s JOIN edges a ON a.child = start JOIN edges b ON b.child = a.parent
  UNION ALL SELECT start, b.child, 2, 5, a.ord, b.ord FROM s JOIN edges a ON a.child = start JOIN edges b ON b.parent = a.parent),
f AS (SELECT *, row_number() OVER (PARTITION BY start, id ORDER BY ring, o1, o2) AS first FROM r),
k AS (SELECT start, id, hops, row_number() OVER (PARTITION BY start ORDER BY ring, o1, o2, id) AS rank FROM f WHERE first = 1)
SELECT start, id, hops, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 30""")
def q29_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    found = H.neighbourhood(edges(spark, sf), members(spark, sf, SUPPLIERS))
    return found.select("start", "id", "hops", F.col("rank").cast("int").alias("rank"))


VIEWS = """
atoms AS (SELECT c_mktsegment AS cui, CASE WHEN c_nationkey % 3 = 0 THEN 'FRE' ELSE 'ENG' END AS lat, CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END AS ispref,
  CASE WHEN c_custkey % 5 = 0 THEN 'P' ELSE 'S' END AS ts, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS aui, c_name AS str, 'SEG' AS sab, CAST(c_nationkey AS VARCHAR) AS code FROM customer),
kinds AS (SELECT DISTINCT c_mktsegment AS cui, n_name AS sty FROM customer JOIN nation ON n_nationkey = c_nationkey),
ents AS (SELECT o_orderkey AS doc, o_orderstatus || ';' || CAST(o_custkey % 30 AS VARCHAR) AS raw FROM orders)
"""


def views(spark: SparkSession, sf: str) -> Callable[[str], str]:
    """Register the staging views under names of this call's own; returns the name of a view by its plain one."""
    own = uuid.uuid4().hex
    name = lambda plain: f"{plain}_{own}"
    customer = table(spark, sf, "customer")
    customer.select(
        F.col("c_mktsegment").alias("cui"), F.when(F.col("c_nationkey") % 3 == 0, "FRE").otherwise("ENG").alias("lat"), F.when(F.col("c_custkey") % 2 == 0, "Y").otherwise("N").alias("ispref"),
        F.when(F.col("c_custkey") % 5 == 0, "P").otherwise("S").alias("ts"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("aui"), F.col("c_name").alias("str"), F.lit("SEG").alias("sab"), F.col("c_nationkey").cast("string").alias("code"),
    ).createOrReplaceTempView(name("kg_atoms"))
    nation = table(spark, sf, "nation")
    customer.join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_mktsegment").alias("cui"), F.col("n_name").alias("sty")).distinct().createOrReplaceTempView(name("kg_types"))
    table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), F.split(F.concat("o_orderstatus", F.lit(";"), (F.col("o_custkey") % 30).cast("string")), ";").alias("ids")).createOrReplaceTempView(name("kg_entities"))
    return name


@query(f"""WITH {VIEWS}, e AS (SELECT cui, str FROM atoms WHERE lat = 'ENG' QUALIFY row_number() OVER (PARTITION BY cui ORDER BY CASE WHEN ispref = 'Y' THEN 0 ELSE 1 END, CASE WHEN ts = 'P' THEN 0 ELSE 1 END, aui) = 1),
a AS (SELECT cui, min(str) AS str FROM atoms GROUP BY cui), k AS (SELECT cui, string_agg(DISTINCT sty, '|' ORDER BY sty) AS semantic_type FROM kinds GROUP BY cui)
SELECT a.cui, coalesce(e.str, a.str) AS preferred_name, semantic_type FROM a LEFT JOIN e ON a.cui = e.cui LEFT JOIN k ON a.cui = k.cui""")
def q38_kg_concepts(spark: SparkSession, sf: str) -> DataFrame:
    name = views(spark, sf)
    return kg.concepts(spark, name("kg_atoms"), name("kg_types"))


@query(f"""WITH {VIEWS}, ids AS (SELECT DISTINCT unnest(string_split(raw, ';')) AS id FROM ents), c AS (SELECT code, min(cui) AS cui FROM atoms GROUP BY code)
SELECT 'orders' AS source_dataset, 'entities' AS source_table, id AS source_id, cui, 'identifier' AS xref_type FROM ids JOIN c ON id = code
UNION SELECT DISTINCT 'segments', sab, code, cui, 'atom' FROM atoms""")
def q39_kg_xrefs(spark: SparkSession, sf: str) -> DataFrame:
    name = views(spark, sf)
    own = kg.annotation_xrefs(spark, name("kg_entities"), name("kg_atoms"), "orders", ("SEG",))
    return own.union(kg.vocabulary_xrefs(spark, name("kg_atoms"), "segments")).distinct()


@query(f"""WITH {VIEWS}, c AS (SELECT code, min(cui) AS cui FROM atoms GROUP BY code),
r AS (SELECT CAST(l_orderkey % 50 AS VARCHAR) AS doc, l_returnflag AS rel, CAST(l_suppkey % 30 AS VARCHAR) AS s, CAST(l_partkey % 30 AS VARCHAR) AS o FROM lineitem),
d AS (SELECT DISTINCT 'lines' AS source_dataset, doc AS source_doc_id, rel AS relation_type, x.cui AS subject_cui, y.cui AS object_cui, s AS subject_source_id, o AS object_source_id FROM r JOIN c x ON s = x.code JOIN c y ON o = y.code),
v AS (SELECT 'regions' AS source_dataset, CAST(NULL AS VARCHAR) AS source_doc_id, 'RO' AS relation_type, a.n_name AS subject_cui, b.n_name AS object_cui, CAST(NULL AS VARCHAR) AS subject_source_id, CAST(NULL AS VARCHAR) AS object_source_id
      FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey)
SELECT source_dataset, relation_type, subject_cui, object_cui, count(*) AS n FROM (SELECT * FROM d UNION ALL SELECT * FROM v) GROUP BY ALL""")
def q40_kg_relations(spark: SparkSession, sf: str) -> DataFrame:
    name = views(spark, sf)
    lines = table(spark, sf, "lineitem")
    number = lambda c, n: (F.col(c) % n).cast("string")
    lines.select(number("l_orderkey", 50).alias("pmid"), F.col("l_returnflag").alias("relation_type"), number("l_suppkey", 30).alias("subject_id"), number("l_partkey", 30).alias("object_id"), F.lit(None).cast("string").alias("novelty"), F.lit(None).cast("string").alias("evidence")).createOrReplaceTempView(name("kg_lines"))
    spark.sql("SELECT 'lines' AS source_dataset, code AS source_id, cui FROM " + name("kg_atoms")).createOrReplaceTempView(name("kg_line_xrefs"))
    nation = table(spark, sf, "nation")
    other = nation.select(F.col("n_name").alias("cui2"), "n_regionkey")
    nation.join(other, "n_regionkey").select(F.col("n_name").alias("cui1"), "cui2", F.lit("RO").alias("rel"), F.lit("").alias("rela")).createOrReplaceTempView(name("kg_rels"))
    own = kg.annotation_relations(spark, name("kg_lines"), name("kg_line_xrefs"), "lines").unionByName(kg.vocabulary_relations(spark, name("kg_rels"), "regions"))
    kept = kg.insert_ignore(own, kg.RELATION_KEY)
    return kept.groupBy("source_dataset", "relation_type", "subject_cui", "object_cui").agg(F.count("*").alias("n"))


@query("""
SELECT 'lineitem_part' AS name, count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 40)
UNION ALL SELECT 'orders_customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal >= 0)""")
def q41_integrity(spark: SparkSession, sf: str) -> DataFrame:
    lines = kg.orphans(table(spark, sf, "lineitem"), "l_partkey", table(spark, sf, "part").filter("p_size < 40"), "p_partkey")
    orders = kg.orphans(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").filter("c_acctbal >= 0"), "c_custkey")
    return kg.row_counts({"lineitem_part": lines, "orders_customer": orders}).withColumnRenamed("rows", "orphans")


@query("SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def q41b_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return kg.row_counts({t: table(spark, sf, t) for t in ("customer", "orders", "lineitem")})


@query("SELECT c_nationkey, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS r FROM customer) WHERE r = 1")
def q41c_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return kg.upsert(table(spark, sf, "customer"), ["c_nationkey"], "c_custkey").select("c_nationkey", "c_custkey", "c_name")


@query("""
WITH v AS (SELECT CAST(user_id % 40 AS BIGINT) AS code, event_type AS target_id, count(*) AS votes FROM events GROUP BY ALL),
soft AS (SELECT code, target_id, votes / sum(votes) OVER (PARTITION BY code) AS prob FROM v WHERE target_id <> 'error'),
c AS (SELECT code, target_id AS chosen FROM v QUALIFY row_number() OVER (PARTITION BY code ORDER BY votes DESC, target_id) = 1),
l AS (SELECT code, target_id, prob * CASE WHEN target_id = chosen THEN 2 ELSE 1 END AS prob FROM soft JOIN c USING (code)
      UNION ALL SELECT code, chosen, 0.5 FROM c WHERE NOT EXISTS (SELECT 1 FROM soft s WHERE s.code = c.code AND s.target_id = c.chosen) AND EXISTS (SELECT 1 FROM soft s WHERE s.code = c.code))
SELECT code, target_id, round(prob / sum(prob) OVER (PARTITION BY code), 6) AS prob FROM l""")
def q31_soft_boost(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select((F.col("user_id") % 40).cast("long").alias("code"), F.col("event_type").alias("target_id"))
    counts = soft.votes(rows)
    base = counts.filter("target_id <> 'error'").withColumn("prob", F.col("votes") / F.sum("votes").over(Window.partitionBy("code"))).select("code", "target_id", "prob")
    return soft.boost(base, counts).select("code", "target_id", F.round("prob", 6).alias("prob"))


@query("""
WITH s AS (SELECT l_partkey AS code, l_suppkey AS target_id, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
m AS (SELECT o_orderkey AS mention, o_custkey AS code, o_custkey AS mapped_id FROM orders),
j AS (SELECT mention, coalesce(target_id, mapped_id) AS target_id, coalesce(q, 1) AS prob FROM m LEFT JOIN s USING (code)),
g AS (SELECT mention, target_id, sum(prob) AS prob FROM j GROUP BY ALL)
SELECT mention, target_id, round(prob / sum(prob) OVER (PARTITION BY mention), 9) AS prob FROM g""")
def q30_soft_targets(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("target_id")).agg(F.sum("l_quantity").alias("prob"))
    mentions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("mention"), F.col("o_custkey").alias("code"), F.col("o_custkey").alias("mapped_id"), F.lit(None).cast("double").alias("confidence"))
    return soft.norm_targets(mentions, base).select("mention", "target_id", F.round("prob", 9).alias("prob"))


@query(WITH + """, p AS (SELECT o_orderkey AS doc, 'n' || CAST(c_nationkey AS VARCHAR) AS gold, CASE o_orderkey % 3 WHEN 0 THEN 'n' || CAST(c_nationkey AS VARCHAR) WHEN 1 THEN 'r' || CAST(n_regionkey AS VARCHAR) ELSE 'r0' END AS pred
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
u AS (SELECT DISTINCT start, reached FROM up)
SELECT count(*) AS rows, round(avg(CASE WHEN pred = gold THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(CASE WHEN pred = gold OR reached IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS ancestor_accuracy
FROM p LEFT JOIN u ON start = gold AND reached = pred""")
def q37_ancestor_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.metrics import concept_accuracy

    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(nation), F.col("n_nationkey") == F.col("c_nationkey"))
    gold = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    pred = F.when(F.col("o_orderkey") % 3 == 0, gold).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).otherwise("r0")
    rows = rows.select(F.col("o_orderkey").alias("doc"), F.lit(0).alias("span"), gold.alias("gold"), pred.alias("target_id"))
    found = concept_accuracy(rows.select("doc", "span", "target_id"), rows.select("doc", "span", F.col("gold").alias("target_id"), F.lit(1.0).alias("prob")), H.closure(edges(spark, sf), members(spark, sf, NATIONS)))
    return found.select("rows", F.round("top1", 6).alias("top1"), F.round("ancestor_accuracy", 6).alias("ancestor_accuracy"))
