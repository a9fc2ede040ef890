"""Readers and writers over files that Spark writes from the given tables, and the small column rules of loading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import constraints, features, kg, soft
from ..operators import hierarchy as H
from ..schemas import RRF
from ..sources import annotated, vocabulary
from ..sources import documents as files
from .annotation_queries import ENTITIES, documents
from .base import query, table
from .document_queries import several
from .graph_queries import NEAR, REGIONS, WITH, edges, members, nearest


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{H.shared_folder(spark)}/files-{uuid.uuid4().hex}"


def text_of(spark: SparkSession, df: DataFrame, separator: str, names: list[str], header: bool = False, bar: bool = False) -> str:
    """The path of a text file of the columns in the order of `names`, those that df lacks being empty."""
    path = folder(spark)
    fields = [F.coalesce(F.col(n).cast("string"), F.lit("")) if n in df.columns else F.lit("") for n in names]
    line = F.concat(F.concat_ws(separator, *fields), F.lit(separator if bar else ""))
    if header:
        df.select(*(f.alias(n) for f, n in zip(fields, names, strict=True))).write.option("sep", separator).option("header", "true").option("quote", "").option("emptyValue", "").csv(path)
    else:
        df.select(line.alias("value")).write.text(path)
    return path


def conso(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as atoms, through pipe-separated files of unequal sizes; the files' names and the rows in them follow their numbers."""
    customer = table(spark, sf, "customer")
    customer = customer.repartitionByRange(6, F.sqrt("c_custkey")).sortWithinPartitions("c_custkey")
    rows = customer.select(
        F.concat(F.lit("K"), (F.col("c_custkey") % 50).cast("string")).alias("cui"), F.when(F.col("c_nationkey") % 3 == 0, "FRE").otherwise("ENG").alias("lat"), F.when(F.col("c_custkey") % 2 == 0, "MSH").otherwise("SEG").alias("sab"),
        F.when(F.col("c_custkey") % 5 == 0, "MH").otherwise("ET").alias("tty"), F.when(F.col("c_custkey") % 11 == 0, "NOCODE").otherwise(F.col("c_nationkey").cast("string")).alias("code"), F.col("c_name").alias("str"),
    )
    return vocabulary.read_rrf(spark, text_of(spark, rows, "|", RRF["MRCONSO"], bar=True), "MRCONSO")


def rrf(spark: SparkSession, name: str, rows: DataFrame) -> DataFrame:
    return vocabulary.read_rrf(spark, text_of(spark, rows, "|", RRF[name], bar=True), name)


ATOMS = """a AS (SELECT c_custkey AS n, 'K' || CAST(c_custkey % 50 AS VARCHAR) AS cui, CASE WHEN c_nationkey % 3 = 0 THEN 'FRE' ELSE 'ENG' END AS lat, CASE WHEN c_custkey % 2 = 0 THEN 'MSH' ELSE 'SEG' END AS sab,
CASE WHEN c_custkey % 5 = 0 THEN 'MH' ELSE 'ET' END AS tty, CASE WHEN c_custkey % 11 = 0 THEN 'NOCODE' ELSE CAST(c_nationkey AS VARCHAR) END AS code, c_name AS str FROM customer)"""


@query(f"WITH {ATOMS} SELECT cui, sab, tty, code, str FROM a WHERE lat = 'ENG' AND sab = 'MSH' AND code <> 'NOCODE'")
def q57_rrf_atoms(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms of a pipe-separated file: English rows of one vocabulary with a code."""
    none = lambda name: spark.createDataFrame([], ", ".join(f"{c} string" for c in RRF[name]) + ", ord long")
    own = vocabulary.load_filter(conso(spark, sf), True, ("MSH",))
    return vocabulary.vocabulary_tables(own, none("MRREL"), none("MRSTY"), none("MRMAP"))["atoms"].drop("ord")


@query("""SELECT 'rels' AS name, 'n' || CAST(n_nationkey AS VARCHAR) AS a, 'RO' AS b, 'r' || CAST(n_regionkey AS VARCHAR) AS c FROM nation
UNION ALL SELECT DISTINCT 'types', 'r' || CAST(n_regionkey AS VARCHAR), n_name, NULL FROM nation
UNION ALL SELECT 'curated', 'M', CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'c' END || CAST(c_custkey AS VARCHAR), 't' || CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_custkey % 7 <> 0""")
def q57b_rrf_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Relations, types and curated maps of their pipe-separated files; a map without a target goes."""
    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rel = rrf(spark, "MRREL", nation.select(key("n", "n_nationkey").alias("cui1"), F.lit("RO").alias("rel"), key("r", "n_regionkey").alias("cui2")))
    sty = rrf(spark, "MRSTY", nation.select(key("r", "n_regionkey").alias("cui"), F.col("n_name").alias("sty")))
    even = F.col("c_custkey") % 2 == 0
    maps = rrf(spark, "MRMAP", customer.select(
        F.lit("M").alias("mapsetsab"), F.when(even, key("x", "c_custkey")).alias("fromexpr"), key("c", "c_custkey").alias("fromid"), F.when(F.col("c_custkey") % 7 != 0, key("t", "c_nationkey")).alias("toid"),
    ))
    found = vocabulary.vocabulary_tables(conso(spark, sf), rel, sty, maps)
    out = found["rels"].select(F.lit("rels").alias("name"), F.col("cui1").alias("a"), F.col("rel").alias("b"), F.col("cui2").alias("c"))
    out = out.union(found["types"].select(F.lit("types"), "cui", "sty", F.lit(None).cast("string")))
    return out.union(found["curated"].select(F.lit("curated"), "mapset", "from_code", "to_code"))


@query(f"""WITH {ATOMS}, n AS (SELECT cui, min_by(str, n) AS name FROM a WHERE sab = 'MSH' AND tty = 'MH' GROUP BY cui), c AS (SELECT code, cui, min(n) AS place FROM a WHERE sab = 'MSH' GROUP BY ALL),
b AS (SELECT code, min_by(name, place) AS name FROM c JOIN n USING (cui) GROUP BY code)
SELECT CAST(n_nationkey AS VARCHAR) AS code, coalesce(name, n_name) AS name FROM nation LEFT JOIN b ON code = CAST(n_nationkey AS VARCHAR)""")
def q57c_source_names(spark: SparkSession, sf: str) -> DataFrame:
    codes = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("fallback"))
    return soft.preferred_source_names(codes, conso(spark, sf))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS term FROM part WHERE p_size < 40")
def q58_reference_set(spark: SparkSession, sf: str) -> DataFrame:
    """Active rows of a tab-separated release file whose header names are known."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 40, 1).otherwise(0).alias("active"), F.col("p_brand").alias("conceptId"), F.col("p_name").alias("term"))
    rows = vocabulary.read_reference_set(spark, text_of(spark, part, "\t", ["id", "active", "conceptId", "term"], header=True), True)
    return vocabulary.active_concepts(rows).join(rows.select("id", "term"), "id")


@query(f"""WITH {ENTITIES}, d AS (SELECT pmid, k, count(*) AS entities, string_agg(code, ',' ORDER BY pos) AS codes FROM e GROUP BY ALL)
SELECT pmid, 'Order ' || pmid || CASE WHEN k % 2 = 0 THEN ' open' ELSE '' END AS text, CAST(entities AS INTEGER) AS entities, CAST(entities - 1 AS INTEGER) AS relations, codes FROM d""")
def q59_document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON lines and read again."""
    path = folder(spark)
    files.write_documents(documents(spark, sf), path)
    docs = files.read_documents(spark, path)
    return docs.select("pmid", "text", F.size("entities").alias("entities"), F.size("relations").alias("relations"), F.array_join(F.transform("entities", lambda e: e["original_code"]), ",").alias("codes"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS code, 'S' || CAST(p_size AS VARCHAR) AS target_id, CASE p_partkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS confidence, p_size < 25 AS target_active FROM part WHERE p_size % 10 <> 0""")
def q60_mapping_file(spark: SparkSession, sf: str) -> DataFrame:
    """A mapping as CSV: rows without a target go, a confidence that is empty or no number is 0."""
    path, size = folder(spark), F.col("p_size").cast("string")
    confidence = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, "n/a").otherwise(size)
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("mesh_id"), F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("S"), size)).otherwise(" ").alias("snomed_id"), confidence.alias("confidence"), F.when(F.col("p_size") < 25, "True").otherwise("").alias("snomed_active"))
    files.write_table(rows, path, "mesh_id")
    return files.read_mapping(spark, path)


@query("SELECT l_returnflag AS flag, count(*) AS lines, CAST(NULL AS VARCHAR) AS note FROM lineitem GROUP BY 1")
def q60b_summary_file(spark: SparkSession, sf: str) -> DataFrame:
    """A summary as JSON objects, nulls kept, read again."""
    path = folder(spark)
    files.write_summary(table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("lines")).withColumn("note", F.lit(None).cast("string")), path)
    return spark.read.schema("flag string, lines long, note string").json(path)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '\\N' ELSE replace(c_name, '#', '\\t') || '\\\\' END AS name, CASE WHEN c_acctbal >= 0 THEN 't' ELSE 'f' END AS flag, '{"' || c_mktsegment || '","a\\"b"}' AS tags FROM customer""")
def q60c_copy_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the text form of bulk loads, written and read as text."""
    name = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.replace("c_name", F.lit("#"), F.lit("\t")), F.lit("\\")))
    path = folder(spark)
    files.write_copy(table(spark, sf, "customer").select("c_custkey", name.alias("name"), (F.col("c_acctbal") >= 0).alias("flag"), F.array("c_mktsegment", F.lit('a"b')).alias("tags")), path)
    part = F.split("value", "\t")
    return spark.read.text(path).select(F.get(part, F.lit(0)).cast("long").alias("c_custkey"), F.get(part, F.lit(1)).alias("name"), F.get(part, F.lit(2)).alias("flag"), F.get(part, F.lit(3)).alias("tags"))


@query("""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS pmid, CAST(l_suppkey AS VARCHAR) AS code FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal >= 0 AND l_quantity > 10""")
def q61_concept_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted codes of a bulk file; lines with fewer than four fields are skipped."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.lit("Chemical").alias("type"), F.concat(F.lit("MESH:"), F.col("l_suppkey").cast("string"), F.lit(";x")).alias("code"), F.lit("name|other").alias("mentions"))
    path = folder(spark)
    full = table(spark, sf, "lineitem").select("l_quantity", "l_orderkey", "l_suppkey")
    short, long = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")), F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.lit("Chemical"), F.concat(F.lit("MESH:"), F.col("l_suppkey").cast("string"), F.lit(";x")), F.lit("name|other"), F.lit("source"))
    full.select(F.when(F.col("l_quantity") > 10, long).otherwise(short).alias("value")).write.option("compression", "gzip").text(path)
    bulk = annotated.read_bulk(spark, path, tuple(rows.columns))
    wanted = table(spark, sf, "supplier").filter("s_acctbal >= 0").select(F.col("s_suppkey").cast("string").alias("code"))
    return annotated.concept_hits(bulk, wanted)


@query("""SELECT o_orderkey, o_orderpriority LIKE '1%' AS flag, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS blank,
CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'mesh:' || CAST(o_custkey AS VARCHAR) END AS exact FROM orders""")
def q62_casts(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("o_custkey").cast("string")
    flag = F.when(F.col("o_orderpriority").startswith("1"), F.when(F.col("o_orderkey") % 2 == 0, "T").otherwise(" 1")).otherwise("false")
    exact = X.strip_prefix(F.concat(F.when(F.col("o_custkey") % 2 == 0, "MESH:").otherwise("mesh:"), number))
    day = X.to_day(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit(" ")))
    return table(spark, sf, "orders").select("o_orderkey", X.to_flag(flag).alias("flag"), F.date_format(day, "yyyy-MM-dd").alias("day"), X.blank_to_null(F.when(F.col("o_custkey") % 3 == 0, "  ").otherwise(number)).alias("blank"), exact.alias("exact"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'D' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') END AS single, CAST(CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS codes,
CASE WHEN o_custkey % 3 = 1 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS normalised, CAST(CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END AS INTEGER) AS listed FROM orders""")
def q62b_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    number, third = F.col("o_custkey").cast("string"), F.col("o_custkey") % 3
    mesh = X.mesh_identifiers(F.when(third == 0, F.concat(F.lit(" D"), F.lpad(number, 6, "0"))).when(third == 1, "-").otherwise("D000001|D000002"))
    listed = X.listed_identifiers(F.when(third == 0, number).when(third == 1, " ").otherwise(F.concat(number, F.lit(", ,b"))))
    return table(spark, sf, "orders").select("o_orderkey", mesh["single"].alias("single"), F.size(mesh["ids"]).alias("codes"), listed["normalised"].alias("normalised"), F.size(listed["ids"]).alias("listed"))


@query("SELECT o_orderkey, round(1.0 + (0.1 - 1.0) * (o_orderkey % 10) / 9, 9) AS tau FROM orders")
def q62c_anneal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.round(X.anneal(F.col("o_orderkey") % 10, 10, 1.0, 0.1), 9).alias("tau"))


@query("WITH t AS (SELECT DISTINCT p_name AS term FROM part) SELECT term, row_number() OVER (ORDER BY substr(md5(term), 1, 3), term) - 1 AS index FROM t")
def q63_term_pool(spark: SparkSession, sf: str) -> DataFrame:
    return features.term_pool(several(spark, sf)).withColumn("index", F.col("index").cast("long"))


@query("""WITH b AS (SELECT p_partkey // 32 AS batch, p_partkey AS pos, p_brand AS concept_id, min(p_partkey) OVER (PARTITION BY p_partkey // 32, p_brand) AS f FROM part)
SELECT batch, pos, concept_id, CAST(dense_rank() OVER (PARTITION BY batch ORDER BY f) - 1 AS INTEGER) AS label FROM b""")
def q63b_batch_labels(spark: SparkSession, sf: str) -> DataFrame:
    return features.batch_labels(table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 32).alias("batch"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("concept_id")))


LOSS = """, p AS (SELECT k.vec_id AS anchor, a.label = b.label AS same, sim FROM k JOIN embeddings a ON a.vec_id = k.vec_id JOIN embeddings b ON b.vec_id = k.other WHERE rank <= 5),
h AS (SELECT *, min(sim) FILTER (same) OVER (PARTITION BY anchor) AS low, max(sim) FILTER (NOT same) OVER (PARTITION BY anchor) AS high FROM p),
g AS (SELECT anchor, sum(CASE WHEN same AND sim - 0.1 < high THEN exp(-2 * (sim - 0.5)) END) AS pull, sum(CASE WHEN NOT same AND sim + 0.1 > low THEN exp(50 * (sim - 0.5)) END) AS push FROM h GROUP BY anchor)
SELECT anchor, round(ln(1 + coalesce(pull, 0)) / 2 + ln(1 + coalesce(push, 0)) / 50, 4) + 0.0 AS loss FROM g"""


@query("WITH z AS (SELECT 1)" + NEAR.rstrip() + LOSS)
def q63c_similarity_loss(spark: SparkSession, sf: str) -> DataFrame:
    """The loss of each query vector among its five nearest ones, of which those of its label are the same."""
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    pairs = nearest(spark, sf).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("other"), F.col("label").alias("_l")), "other")
    found = features.multi_similarity_loss(pairs.select(F.col("vec_id").alias("anchor"), "other", (F.col("label") == F.col("_l")).alias("same"), F.col("sim").alias("similarity")))
    return found.select("anchor", (F.round("loss", 4) + F.lit(0.0)).alias("loss"))


@query("SELECT DISTINCT p_brand AS id FROM part ORDER BY id LIMIT 10")
def q63d_first_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return features.first_concepts(table(spark, sf, "part").select(F.col("p_brand").alias("id")), 10)


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def q64_latest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return kg.latest(table(spark, sf, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderstatus")


CHOICES = "s AS (SELECT l_partkey AS code, l_suppkey AS target_id, min(l_linenumber) AS hops, round(sum(l_quantity), 0) AS prob FROM lineitem GROUP BY ALL)"


def choices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("code"), F.col("l_suppkey").alias("target_id")).agg(F.min("l_linenumber").alias("hops"), F.round(F.sum("l_quantity"), 0).alias("prob"))


@query(f"WITH {CHOICES} SELECT code, string_agg(CAST(target_id AS VARCHAR), ',' ORDER BY prob DESC, hops, target_id) AS targets FROM s GROUP BY code")
def q64b_candidate_lists(spark: SparkSession, sf: str) -> DataFrame:
    return soft.candidate_lists(choices(spark, sf)).select("code", F.array_join(F.transform("candidates", lambda c: c["target_id"].cast("string")), ",").alias("targets"))


@query(f"""WITH {CHOICES}, c AS (SELECT code, count(*) AS n, max(prob) FILTER (hops = 1) AS main, avg(prob) AS mean FROM s GROUP BY code)
SELECT count(*) AS codes, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean_candidates, min(main) AS primary_min, max(main) AS primary_max, round(avg(main), 6) AS primary_mean, round(avg(mean), 6) AS mean_of_means FROM c""")
def q64c_soft_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Hops here count from 1, so the line with the first number is the primary one."""
    found = soft.soft_summary(choices(spark, sf).withColumn("hops", F.col("hops") - 1).withColumn("similarity", F.col("prob")))
    return found.select(*(F.round(c, 6).alias(c) if c in ("mean_candidates", "primary_mean", "mean_of_means") else F.col(c) for c in found.columns))


@query(WITH + """, n AS (SELECT child AS id FROM edges UNION SELECT parent FROM edges)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT max(d) FROM (SELECT min(hops) AS d FROM up WHERE reached = 'root' GROUP BY start)) AS max_depth,
(SELECT count(*) FROM (SELECT start FROM up JOIN edges ON child = reached AND parent = 'root' GROUP BY start HAVING count(DISTINCT reached) > 1)) AS multi_inherit""")
def q65_graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A tree: every node is under one top, and customers lie three steps below the root."""
    rows = edges(spark, sf)
    found = H.nodes(rows.select(F.col("child").alias("id"), F.lit("1").alias("active")), rows)
    return H.graph_stats(rows, found, H.depths(rows, "root"), H.memberships(rows, "root"))


CLASSES = {"disease": ("r0", "r1"), "chemical": ("r2",)}


@query(WITH + """, a(semantic_class, anchor) AS (VALUES ('disease', 'r0'), ('disease', 'r1'), ('chemical', 'r2'))
SELECT semantic_class, start AS concept FROM up JOIN a ON reached = anchor UNION SELECT semantic_class, anchor FROM a""")
def q66_compatible_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return constraints.compatible_concepts(H.closure(edges(spark, sf), members(spark, sf, REGIONS), up=False), CLASSES)


@query("""WITH k(c, region) AS (VALUES ('disease', 0), ('disease', 1), ('chemical', 2)), n AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS relation, CAST(n_regionkey AS INTEGER) AS d, CAST(n_nationkey % 5 AS INTEGER) AS r FROM nation),
x AS (SELECT relation, a.c AS subject_class, b.c AS object_class, bool_or(a.region = d) AND bool_or(b.region = r OR r = 4) AS valid FROM n CROSS JOIN k a CROSS JOIN k b GROUP BY ALL) SELECT * FROM x""")
def q66b_valid_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A nation is a relation from its region to another region, or to anything if that is the last one."""
    region = lambda c: F.concat(F.lit("r"), c.cast("string"))
    other = F.col("n_nationkey") % 5
    side = lambda c: F.array(F.struct(F.array(c).alias("roots")))
    rows = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("relation"), side(region(F.col("n_regionkey"))).alias("domains"), side(F.when(other == 4, "root").otherwise(region(other))).alias("ranges"))
    below = H.closure(edges(spark, sf), spark.createDataFrame([("root",)], "id string"), up=False)
    return constraints.valid_pairs(rows, below, CLASSES)


@query("""WITH p AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'treat' WHEN 'R' THEN 'cause' ELSE 'compare' END AS relation FROM lineitem)
SELECT relation, CASE relation WHEN 'treat' THEN 'treats' WHEN 'cause' THEN 'causes' ELSE 'associated-with' END AS label, count(*) AS relations FROM p
WHERE l_quantity > 5 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P') GROUP BY ALL""")
def q67_relation_counts(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.silver import relation_counts
    from .silver_queries import bulk

    return relation_counts(bulk(spark, sf))
