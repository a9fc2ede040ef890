"""Attribute rules and their terms, synthetic documents as a whole, and the remaining file forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import constraints
from ..operators import documents as D
from ..operators import hierarchy as H
from ..sources import documents as files
from ..sources.order import place
from .annotation_queries import ENTITIES, documents
from .base import query, table
from .graph_queries import WITH
from .silver_queries import KINDS, triples_of


def folder(spark: SparkSession, name: str) -> str:
    return f"{H.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH r AS (SELECT l_partkey AS id, l_linenumber % 2 = 1 AS is_full, 'P' || CAST(l_suppkey AS VARCHAR) || CASE WHEN l_quantity > 40 THEN ' (x)' ELSE '' END AS term, l_orderkey * 10 + l_linenumber AS ord
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_tax > 0.01 AND p_size < 30),
f AS (SELECT id, min(ord) AS first FROM r GROUP BY id)
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN min(term) FILTER (ord = first) LIKE '%)' THEN min(term) FILTER (ord = first)
  ELSE coalesce(arg_min(term, ord) FILTER (is_full AND ord > first AND term LIKE '%)'), arg_max(term, ord) FILTER (is_full AND ord > first), min(term) FILTER (ord = first)) END AS term FROM r JOIN f USING (id) GROUP BY id""")
def q77_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """One term for each needed part from the names that its lines give it."""
    term = F.concat(F.lit("P"), F.col("l_suppkey").cast("string"), F.when(F.col("l_quantity") > 40, " (x)").otherwise(""))
    rows = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("concept_id"), F.when(F.col("l_linenumber") % 2 == 1, "full").otherwise("other").alias("type_id"), term.alias("term"),
        F.when(F.col("l_tax") > 0.01, "1").otherwise("0").alias("active"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return constraints.descriptions(rows, table(spark, sf, "part").filter("p_size < 30").select(F.col("p_partkey").cast("string").alias("id")), "full")


RULES = """dom AS (SELECT 'D' || CAST(n_nationkey AS VARCHAR) AS domain, CASE WHEN n_nationkey % 2 = 0 THEN CAST(2000000 + n_nationkey AS VARCHAR) || '|' || CAST(3000000 + n_regionkey AS VARCHAR) ELSE 'D' || CAST(n_nationkey AS VARCHAR) END AS roots FROM nation WHERE n_nationkey % 5 <> 4),
att AS (SELECT CAST(500000 + s_suppkey // 2 AS VARCHAR) AS attribute, 'D' || CAST(s_nationkey AS VARCHAR) AS domain, s_suppkey AS ord, CASE WHEN s_suppkey % 3 = 0 THEN 'Mandatory CM rule' ELSE 'r' || CAST(s_suppkey % 3 AS VARCHAR) END AS strength FROM supplier WHERE s_acctbal > -500),
d AS (SELECT attribute, string_agg(att.domain || ':' || coalesce(roots, att.domain) || ':' || strength, ',' ORDER BY ord) AS domains FROM att LEFT JOIN dom USING (domain) GROUP BY attribute),
rng AS (SELECT CAST(500000 + p_partkey % 700 AS VARCHAR) AS attribute, p_partkey AS ord, CAST(4000000 + p_partkey % 50 AS VARCHAR) AS a, CAST(5000000 + p_size AS VARCHAR) AS b FROM part WHERE p_size < 45),
r AS (SELECT attribute, string_agg(a || '|' || b, ',' ORDER BY ord) AS ranges FROM rng GROUP BY attribute)"""


def rules(spark: SparkSession, sf: str) -> DataFrame:
    text = lambda base, c: (F.lit(base) + c).cast("string")
    even = F.col("n_nationkey") % 2 == 0
    domains = table(spark, sf, "nation").select(
        F.concat(F.lit("D"), F.col("n_nationkey").cast("string")).alias("referenced_id"), F.when(even, F.concat(F.lit("<< "), text(2000000, F.col("n_nationkey")), F.lit(" OR < "), text(3000000, F.col("n_regionkey")))).otherwise("").alias("domain_constraint"),
        F.when(F.col("n_nationkey") % 5 != 4, "1").otherwise("0").alias("active"),
    )
    attributes = table(spark, sf, "supplier").select(
        text(500000, F.expr("s_suppkey div 2")).alias("referenced_id"), F.concat(F.lit("D"), F.col("s_nationkey").cast("string")).alias("domain_id"), F.lit("1").alias("grouped"), F.lit("0..1").alias("cardinality"),
        F.when(F.col("s_suppkey") % 3 == 0, "723597001").otherwise(F.concat(F.lit("r"), (F.col("s_suppkey") % 3).cast("string"))).alias("rule_strength_id"), F.lit("x").alias("content_type_id"), F.when(F.col("s_acctbal") > -500, "1").otherwise("0").alias("active"), F.col("s_suppkey").alias("ord"),
    )
    constraint = F.concat(F.lit("<< "), text(4000000, F.col("p_partkey") % 50), F.lit(" |n| OR "), text(5000000, F.col("p_size")))
    ranges = table(spark, sf, "part").select(
        text(500000, F.col("p_partkey") % 700).alias("referenced_id"), constraint.alias("range_constraint"), F.lit("s").alias("rule_strength_id"), F.lit("c").alias("content_type_id"), F.when(F.col("p_size") < 45, "1").otherwise("0").alias("active"), F.col("p_partkey").alias("ord"),
    )
    names = table(spark, sf, "customer").select(text(500000, F.col("c_custkey")).alias("id"), F.col("c_name").alias("term"))
    return constraints.attribute_rules(attributes, ranges, constraints.domain_rules(domains), names)


@query(f"""WITH {RULES} SELECT coalesce(d.attribute, r.attribute) AS attribute, c_name AS name, domains, ranges FROM d FULL JOIN r ON d.attribute = r.attribute LEFT JOIN customer ON CAST(500000 + c_custkey AS VARCHAR) = coalesce(d.attribute, r.attribute)""")
def q77b_attribute_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes with their domains and ranges; some have only one of them."""
    found = rules(spark, sf)
    domain = lambda x: F.concat_ws(":", x["domain"], F.array_join(x["roots"], "|"), x["strength"])
    return found.select("attribute", "name", F.array_join(F.transform("domains", domain), ",").alias("domains"), F.array_join(F.transform("ranges", lambda x: F.array_join(x["roots"], "|")), ",").alias("ranges"))


@query(f"WITH {RULES} SELECT DISTINCT unnest(string_split(coalesce(roots, att.domain), '|')) AS id FROM att LEFT JOIN dom USING (domain) UNION SELECT a FROM rng UNION SELECT b FROM rng")
def q77c_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Every root of a domain or a range."""
    return constraints.anchors(rules(spark, sf))


@query(WITH + f""", k(region, kind) AS (VALUES {KINDS}), b AS (SELECT DISTINCT start AS id, kind FROM up JOIN k ON reached = region),
t AS (SELECT l_orderkey * 8 + l_linenumber AS ord, s_name AS a, c_name AS b, 's' || CAST(l_suppkey AS VARCHAR) AS s, 'c' || CAST(o_custkey AS VARCHAR) AS c, CASE l_returnflag WHEN 'A' THEN 'causative-agent' WHEN 'N' THEN 'due-to' ELSE 'after' END AS label
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey),
x AS (SELECT t.*, row_number() OVER (ORDER BY ord, s, c, CASE label WHEN 'causative-agent' THEN '246075003' WHEN 'due-to' THEN '42752001' ELSE '255234002' END) - 1 AS n FROM t JOIN b x ON s = x.id AND x.kind = 'finding' JOIN b y ON t.c = y.id WHERE CASE WHEN label = 'causative-agent' THEN y.kind IN ('substance', 'product') ELSE y.kind IN ('finding', 'event', 'procedure') END)
SELECT 'SYNTHETIC_' || lpad(CAST(n AS VARCHAR), 7, '0') AS pmid, a || ' ' || label || ' ' || b || '.' AS text,
  '0-' || CAST(length(a) AS VARCHAR) || ',' || CAST(length(a) + length(label) + 2 AS VARCHAR) || '-' || CAST(length(a) + length(label) + 2 + length(b) AS VARCHAR) AS spans, s || ',' || c AS targets FROM x""")
def q79_synthetic_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The synthesised documents themselves: ids in order, texts, spans and targets."""
    triples, terms, below = triples_of(spark, sf)
    docs = D.synthesise(triples, terms, below, least_causative=0)
    span = lambda e: F.concat_ws("-", e["span_start"].cast("string"), e["span_end"].cast("string"))
    return docs.select("pmid", "text", F.array_join(F.transform("entities", span), ",").alias("spans"), F.array_join(F.transform("entities", lambda e: e["mapped_id"]), ",").alias("targets"))


@query("SELECT c_custkey // 100 AS part, c_custkey AS id, c_name AS name FROM customer")
def q78_json_values(spark: SparkSession, sf: str) -> DataFrame:
    """Files that hold one JSON value each, over several lines."""
    path = folder(spark, "json")
    part = F.expr("c_custkey div 100").alias("part")
    groups = table(spark, sf, "customer").groupBy(part).agg(F.collect_list(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))).alias("rows"))
    groups.select(F.to_json(F.struct("part", "rows"), {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = files.read_json(spark, path, "part long, rows array<struct<id: long, name: string>>")
    return found.select("part", F.inline("rows"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0")
def q78b_cached_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table keyed by its input's files: what was built first is read, not built anew."""
    path, inputs = folder(spark, "cache"), [f"{sf}/customer.parquet"]
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    files.cached(spark, path, inputs, lambda: rows.filter("c_acctbal >= 0").drop("c_acctbal"))
    return files.cached(spark, path, inputs, lambda: rows.drop("c_acctbal"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'")
def q78c_first_file(spark: SparkSession, sf: str) -> DataFrame:
    """The first place, by patterns and then by names, that exists."""
    path = folder(spark, "found")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(files.first_match(spark, [f"{path}/o_orderstatus=X*", f"{path}/o_orderstatus=[OP]", f"{path}/*"]))


@query(f"WITH {ENTITIES} SELECT DISTINCT pmid FROM e WHERE split <> 'train'")
def q78d_gold_pmids(spark: SparkSession, sf: str) -> DataFrame:
    """The pmids of development and test documents in folders of any depth."""
    path = folder(spark, "gold")
    docs = H.settled(documents(spark, sf))
    for split in ("train", "dev", "test"):
        files.write_documents(docs.filter(F.col("split") == split), f"{path}/a/{split}" if split != "dev" else f"{path}/{split}")
    return files.read_documents(spark, path).filter("split <> 'train'").select("pmid").distinct()


@query("SELECT row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS place, CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand FROM part")
def q78e_sorted_table(spark: SparkSession, sf: str) -> DataFrame:
    """A sorted CSV table of several files: the rows' places over all files are their ranks."""
    path = folder(spark, "sorted")
    files.write_table(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), "p_name"), path, "brand", "id")
    rows = spark.read.option("header", "true").csv(path)
    rows = H.settled(rows.select("id", "brand", place(rows).alias("ord")))
    counts = rows.groupBy("ord.file", "ord.block").count()
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a file
    counts = counts.select(F.col("file").alias("_file"), F.col("block").alias("_block"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("ord.file", "ord.block").orderBy("ord.row")) - 1
    joined = rows.withColumn("_own", own).join(F.broadcast(counts), (F.col("ord.file") == F.col("_file")) & (F.col("ord.block") == F.col("_block")))
    return joined.select((F.col("_before") + F.col("_own")).alias("place"), "id", "brand")
