"""Whole documents through assembly, stamping and conversion: orders are documents, their lines are annotations and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import documents as D
from ..operators import mapping as M
from ..operators import metrics, sampling, silver, solver
from .base import query, table
from .document_queries import LINES, line_arrays, q45_constraint_solver
from .mapping_queries import BEST, best

CORPUS = "BioRED"
ENTITIES = f"""{LINES}, e AS (SELECT l_orderkey AS k, CAST(l_orderkey AS VARCHAR) AS pmid, CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' ELSE 'test' END AS split, pos, l_linenumber,
  CASE l_returnflag WHEN 'A' THEN 'ChemicalEntity' WHEN 'N' THEN 'DiseaseOrPhenotypicFeature' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'GeneOrGeneProduct' ELSE 'Thing' END END AS etype,
  CASE l_returnflag WHEN 'A' THEN 'chemical' WHEN 'N' THEN 'disease' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'gene' END END AS cls,
  l_returnflag = 'R' AND l_partkey % 2 = 0 AS outside, CAST(l_partkey AS VARCHAR) AS code, l_discount * 10 AS score, min(pos) OVER (PARTITION BY l_orderkey, l_partkey) AS idx FROM lines)"""
ROWS = ", ".join(str((*row, place)) for place, row in enumerate(C.RELATION_MAPPINGS))
RELATIONS = f"""rt(corpus, source, subject, object, target, tier, p, ord) AS (VALUES {ROWS}),
rb AS (SELECT *, count(*) OVER (PARTITION BY source, subject, object) AS candidates FROM rt WHERE corpus = '{CORPUS}' QUALIFY row_number() OVER (PARTITION BY source, subject, object ORDER BY p DESC, ord) = 1),
rc AS (SELECT a.k, a.pmid, a.split, a.pos, a.score, CAST(a.idx AS INTEGER) AS s, CAST(b.idx AS INTEGER) AS o, CASE a.l_linenumber % 4 WHEN 0 THEN 'Association' WHEN 1 THEN 'Positive_Correlation' WHEN 2 THEN 'Bind' ELSE 'Other' END AS rtype
  FROM e a JOIN e b ON b.k = a.k AND b.pos = a.pos + 1),
st AS (SELECT rc.*, coalesce(x.cls, '') AS sc, coalesce(y.cls, '') AS oc, coalesce(target, 'associated-with') AS target, CAST(coalesce(tier, 2) AS INTEGER) AS tier, CAST(coalesce(p, 1) AS DOUBLE) AS p, target IS NULL AS defaulted, CAST(coalesce(candidates, 1) AS INTEGER) AS candidates
  FROM rc JOIN e x ON x.k = rc.k AND x.pos = rc.s JOIN e y ON y.k = rc.k AND y.pos = rc.o LEFT JOIN rb ON source = rtype AND subject = coalesce(x.cls, '') AND object = coalesce(y.cls, ''))"""
MAPPED = "m AS (SELECT CAST(code AS VARCHAR) AS code, CAST(sid AS VARCHAR) AS target_id, conf, s_acctbal >= 0 AS ok FROM best JOIN supplier ON s_suppkey = sid)"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Assembled documents of orders, their split by the number of the order."""
    even = lambda x: x["part"] % 2 == 0
    kind = lambda x: F.when(x["flag"] == "A", "ChemicalEntity").when(x["flag"] == "N", "DiseaseOrPhenotypicFeature").when(even(x), "GeneOrGeneProduct").otherwise("Thing")
    names = F.array(*(F.lit(x) for x in ("Association", "Positive_Correlation", "Bind", "Other")))
    # lines are shuffled as they are and described in their order's row
    docs = line_arrays(spark, sf, part=F.col("l_partkey"), flag=F.col("l_returnflag"), number=F.col("l_linenumber"), discount=F.col("l_discount"))
    line = lambda x: F.struct(kind(x).alias("kind"), x["part"].cast("string").alias("code"), F.get(names, (x["number"] % 4).cast("int")).alias("relation"), (x["discount"] * 10).alias("score"))
    docs = docs.withColumn("lines", F.transform("lines", line))
    mention = lambda x: F.concat(F.lit("P"), x["code"])
    entity = lambda x, i: F.struct((i * 10).alias("start"), (i * 10 + F.char_length(mention(x))).alias("end"), mention(x).alias("mention"), x["kind"].alias("entity_type"), x["code"].alias("code"), F.lit("").alias("extra"))
    pair = lambda x, i: F.struct(x["relation"].alias("relation_type"), x["code"].alias("subject"), F.get("lines", i + 1)["code"].alias("object"), F.lit("").alias("novelty"), x["score"].alias("score"))
    raw = docs.select(
        F.col("doc").cast("string").alias("pmid"), F.concat(F.lit("Order "), F.col("doc").cast("string")).alias("title"), F.when(F.col("doc") % 2 == 0, "open").otherwise("").alias("abstract"),
        F.transform("lines", entity).alias("entities"), F.slice(F.transform("lines", pair), F.lit(1), F.size("lines") - 1).alias("relations"),
    )
    splits = F.array(*(F.lit(x) for x in ("train", "dev", "test")))
    return D.assemble(raw, C.scope(spark), CORPUS, "all").withColumn("split", F.get(splits, (F.col("pmid").cast("long") % 3).cast("int")))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    active = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sid"), (F.col("s_acctbal") >= 0).alias("target_active"))
    return best(spark, sf).join(active, "sid").select(F.col("code").cast("string").alias("code"), F.col("sid").cast("string").alias("target_id"), F.col("conf").alias("confidence"), "target_active")


@query(f"""WITH {ENTITIES} SELECT pmid, 'Order ' || pmid || CASE WHEN k % 2 = 0 THEN ' open' ELSE '' END AS text, 'T' || CAST(pos + 1 AS VARCHAR) AS id, CAST(pos * 10 AS INTEGER) AS span_start,
CAST(pos * 10 + length(code) + 1 AS INTEGER) AS span_end, 'P' || code AS surface_text, etype AS entity_type, cls AS semantic_class, code AS original_code, outside AS out_of_scope FROM e""")
def q50_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("pmid", "text", F.explode("entities").alias("e"))
    return rows.select("pmid", "text", *(F.col(f"e.{c}").alias(c) for c in ("id", "span_start", "span_end", "surface_text", "entity_type", "semantic_class", "original_code", "out_of_scope")))


@query(f"""WITH {ENTITIES}, d AS (SELECT k, split, count(*) AS n FROM e GROUP BY ALL)
SELECT '{CORPUS}' AS corpus, split, count(*) AS documents, CAST(sum(n) AS BIGINT) AS entities, CAST(sum(n - 1) AS BIGINT) AS relations FROM d GROUP BY split""")
def q50b_conversion_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.conversion_summary(documents(spark, sf))


@query(f"WITH {ENTITIES} SELECT '{CORPUS}' AS corpus, etype AS entity_type, count(*) AS mentions FROM e WHERE cls IS NULL GROUP BY etype")
def q50c_unregistered_types(spark: SparkSession, sf: str) -> DataFrame:
    return D.unregistered_types(documents(spark, sf))


@query(f"""{BEST.rstrip()}, {ENTITIES}, {MAPPED}, o AS (SELECT split, NOT outside AND ok AS a, NOT outside AND NOT ok AS i, NOT outside AND ok IS NULL AS u, outside FROM e LEFT JOIN m USING (code)),
c AS (SELECT '{CORPUS}' AS corpus, split, count(*) FILTER (a) AS active, count(*) FILTER (i) AS inactive, count(*) FILTER (u) AS unmapped, count(*) FILTER (outside) AS out_of_scope FROM o GROUP BY split)
SELECT *, round_even(CAST(100 AS DOUBLE) * active / (active + inactive + unmapped), 1) AS active_pct, round_even(CAST(100 AS DOUBLE) * inactive / (active + inactive + unmapped), 1) AS inactive_pct,
round_even(CAST(100 AS DOUBLE) * unmapped / (active + inactive + unmapped), 1) AS unmapped_pct FROM c""")
def q51_mapping_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return D.mapping_shares(D.mapping_outcomes(D.stamp_concepts(D.coded(documents(spark, sf)), targets(spark, sf))))


def stamped_relations(spark: SparkSession, sf: str) -> DataFrame:
    return D.stamp_relations(documents(spark, sf), C.relation_table(spark))


@query(f"""WITH {ENTITIES}, {RELATIONS} SELECT pmid, s AS subject_idx, o AS object_idx, rtype AS source_relation_type, target AS target_relation, tier, p AS probability, sc AS subject_class, oc AS object_class, defaulted, candidates, score FROM st""")
def q52_relation_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = stamped_relations(spark, sf).select("pmid", F.explode("relations").alias("r"))
    return rows.select(
        "pmid", "r.subject_idx", "r.object_idx", "r.source_relation_type", "r.target_relation", "r.tier", F.col("r.target_probability").alias("probability"), "r.extra.subject_class", "r.extra.object_class",
        F.col("r.extra.default_used").alias("defaulted"), F.size("r.extra.target_candidates").alias("candidates"), F.col("r.extra.source_score").alias("score"),
    )


@query(f"""WITH {ENTITIES}, {RELATIONS} SELECT split, target AS target_relation, count(*) AS relations, count(*) FILTER (defaulted) AS defaulted, count(*) FILTER (candidates > 1) AS several, count(*) FILTER (tier = 1) AS tier1,
CAST(grouping(split, target) AS BIGINT) AS level FROM st GROUP BY ROLLUP (split, target)""")
def q52b_relation_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return D.relation_outcomes(stamped_relations(spark, sf)).withColumn("level", F.col("level").cast("long"))


@query(f"WITH {ENTITIES}, {RELATIONS} SELECT rtype AS source_relation_type, sc AS subject_class, oc AS object_class, count(*) AS relations FROM st WHERE defaulted GROUP BY ALL")
def q52c_defaulted_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return D.defaulted_pairs(stamped_relations(spark, sf))


LEAST = 0.5
SILVER = f"""{BEST.rstrip()}, {ENTITIES}, {MAPPED}, {RELATIONS},
sure AS (SELECT e.*, target_id IS NOT NULL AND NOT outside AS mapped FROM e LEFT JOIN (SELECT * FROM m WHERE conf >= 0.8 AND ok) s USING (code) WHERE k % 2 = 0),
se AS (SELECT k, pmid, count(*) AS entities, count(*) FILTER (mapped) AS entities_mapped, coalesce(bool_or(mapped AND cls = 'chemical'), false) AND coalesce(bool_or(mapped AND cls = 'disease'), false) AS pair FROM sure GROUP BY ALL),
sr AS (SELECT k, count(*) AS seen, count(*) FILTER (score >= {LEAST}) AS scored, min_by(target, pos) FILTER (score >= {LEAST}) AS label FROM st GROUP BY k),
sd AS (SELECT se.*, coalesce(seen, 0) AS seen, coalesce(scored, 0) AS scored, label FROM se LEFT JOIN sr USING (k))"""


def silver_inputs(spark: SparkSession, sf: str) -> tuple:
    docs = documents(spark, sf)
    sample = table(spark, sf, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("pmid"))
    return docs, targets(spark, sf), C.relation_table(spark), sample, LEAST


@query(f"{SILVER} SELECT pmid, CAST(entities_mapped AS INTEGER) AS entities_mapped, CAST(scored AS INTEGER) AS relations, label FROM sd WHERE pair AND scored > 0")
def q53_silver_convert(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose number is even are the sample."""
    docs = silver.convert(*silver_inputs(spark, sf))
    return docs.select("pmid", F.size(F.filter("entities", lambda e: e["mapped_id"].isNotNull())).alias("entities_mapped"), F.size("relations").alias("relations"), F.get("relations", F.lit(0))["target_relation"].alias("label"))


@query(f"""{SILVER} SELECT (SELECT count(DISTINCT k) FROM e) AS documents, count(*) AS sampled, count(*) FILTER (pair AND scored > 0) AS kept, count(*) FILTER (NOT pair) AS no_pair, count(*) FILTER (pair AND scored = 0) AS no_relations,
CAST(coalesce(sum(entities), 0) AS BIGINT) AS entities, CAST(coalesce(sum(entities_mapped), 0) AS BIGINT) AS entities_mapped, CAST(coalesce(sum(seen), 0) AS BIGINT) AS relations, CAST(coalesce(sum(scored), 0) AS BIGINT) AS relations_scored FROM sd""")
def q53b_silver_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return silver.conversion_funnel(*silver_inputs(spark, sf))


@query(f"{SILVER} SELECT target AS target_relation, count(*) AS relations FROM st JOIN sd USING (k) WHERE pair AND score >= {LEAST} GROUP BY target")
def q53c_label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return silver.label_distribution(silver.convert(*silver_inputs(spark, sf)))


@query(f"WITH {ENTITIES} SELECT etype AS entity_type, count(*) AS mentions FROM e WHERE cls IS NULL GROUP BY etype ORDER BY mentions DESC, entity_type LIMIT 20")
def q53d_unknown_types(spark: SparkSession, sf: str) -> DataFrame:
    return silver.unknown_types(documents(spark, sf))


NAMES = ("Chemical", "Disease", "Gene", "Species", "Mutation", "CellLine", "Thing")


@query("""WITH n(i, entity_type, canonical_type, semantic_class) AS (VALUES (0, 'Chemical', 'Chemical', 'chemical'), (1, 'Disease', 'Disease', 'disease'), (2, 'Gene', 'GeneOrGeneProduct', 'gene'), (3, 'Species', 'OrganismTaxon', 'species'),
(4, 'Mutation', 'SequenceVariant', 'variant'), (5, 'CellLine', 'CellLine', 'cell_line'), (6, 'Thing', 'Thing', ''))
SELECT entity_type, canonical_type, semantic_class, count(*) AS mentions FROM lineitem JOIN n ON i = l_partkey % 7 GROUP BY ALL""")
def q54_entity_classes(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.get(F.array(*(F.lit(x) for x in NAMES)), (F.col("l_partkey") % 7).cast("int"))
    found = silver.entity_classes(table(spark, sf, "lineitem").select(kind.alias("entity_type")), C.scope(spark))
    return found.groupBy("entity_type", "canonical_type", "semantic_class").agg(F.count("*").alias("mentions"))


@query(f"""{BEST.rstrip()}, {MAPPED}, c(i, semantic_class) AS (VALUES (0, 'chemical'), (1, 'disease'), (2, 'chemical'), (2, 'disease'))
SELECT code, semantic_class FROM m JOIN c ON i = CAST(code AS BIGINT) % 4 WHERE conf >= 0.8 AND ok""")
def q54b_footprint(spark: SparkSession, sf: str) -> DataFrame:
    classes = F.get(F.array(*(F.lit(x) for x in ("chemical", "disease", "chemical,disease", "gene"))), (F.col("code").cast("long") % 4).cast("int"))
    return sampling.footprint(targets(spark, sf).withColumn("classes", classes))


@query(f"""WITH {ENTITIES} SELECT '{CORPUS}' AS corpus, cls AS semantic_class, 'D' || lpad(code, 6, '0') AS code, count(*) AS frequency FROM e WHERE cls IN ('chemical', 'disease') GROUP BY ALL""")
def q54c_harvest(spark: SparkSession, sf: str) -> DataFrame:
    rows = documents(spark, sf).select("corpus", F.explode("entities").alias("e"))
    codes = F.concat(F.lit("-, MESH:D"), F.lpad("e.original_code", 6, "0"))
    return M.harvest(rows.select("corpus", "e.entity_type", codes.alias("codes")), C.scope(spark))


STY = ("Finding", "Hormone", "Neoplastic Process", "Antibiotic")
VOCABULARY = """src AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS code, 'K' || CAST(p_partkey % 997 AS VARCHAR) AS cui FROM part),
tgt AS (SELECT 'K' || CAST(s_suppkey * 3 % 997 AS VARCHAR) AS cui, CASE s_suppkey % 4 WHEN 0 THEN 'PT' WHEN 1 THEN 'FN' WHEN 2 THEN 'SY' ELSE 'XX' END AS tty, CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 99 END AS rank,
  CAST(1000000 + s_suppkey AS VARCHAR) AS target_id, s_name AS term FROM supplier),
tb AS (SELECT * FROM tgt QUALIFY row_number() OVER (PARTITION BY cui ORDER BY rank, length(term), target_id) = 1),
rel AS (SELECT DISTINCT 'K' || CAST(l_partkey % 997 AS VARCHAR) AS cui1, 'K' || CAST(l_suppkey * 3 % 997 AS VARCHAR) AS cui2, CASE l_linenumber WHEN 1 THEN 'SY' WHEN 2 THEN 'RQ' WHEN 3 THEN 'RB' ELSE 'RN' END AS rel FROM lineitem WHERE l_quantity >= 40 AND l_linenumber <= 4),
sty(i, sty, target_id, term) AS (VALUES (0, 'Finding', '404684003', 'Clinical finding'), (1, 'Hormone', '105590001', 'Substance'), (2, 'Neoplastic Process', '108369006', 'Neoplasm'), (3, 'Antibiotic', '373873005', 'Pharmaceutical / biologic product')),
c AS (SELECT DISTINCT 'P' || CAST(l_partkey AS VARCHAR) AS code, target_id, term, tty, rank, CAST(0.95 AS DOUBLE) AS confidence, 'curated:M1' AS method, 1 AS tier FROM lineitem JOIN tgt ON target_id = CAST(1000000 + l_suppkey AS VARCHAR) WHERE l_quantity >= 49
  UNION ALL SELECT code, target_id, term, tty, rank, 0.90, 'shared:' || cui, 2 FROM src JOIN tb USING (cui)
  UNION ALL SELECT DISTINCT code, target_id, term, tty, rank, CAST(CASE rel WHEN 'SY' THEN 0.70 WHEN 'RQ' THEN 0.68 WHEN 'RB' THEN 0.65 ELSE 0.55 END AS DOUBLE), 'hop:' || rel, 3 FROM src JOIN rel ON src.cui = cui1 JOIN tb ON tb.cui = cui2
  UNION ALL SELECT src.code, target_id, term, '', 99, 0.40, 'type:' || sty, 4 FROM src JOIN (SELECT DISTINCT 'K' || CAST(p_partkey % 997 AS VARCHAR) AS cui, p_size % 4 AS i FROM part WHERE p_size < 40) t USING (cui) JOIN sty USING (i))"""


@query(f"""WITH {VOCABULARY} SELECT code, target_id, term, tty, confidence, method, tier FROM c
QUALIFY row_number() OVER (PARTITION BY code ORDER BY tier, confidence DESC, rank, length(term), target_id) = 1""")
def q55_map_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The four tiers over a vocabulary made of parts (source), suppliers (target) and line items (maps and relations)."""
    part, supplier, lines = (table(spark, sf, t) for t in ("part", "supplier", "lineitem"))
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    cui = lambda c: text("K", F.col(c) % 997)
    far = lambda c: text("K", F.col(c) * 3 % 997)
    tty = F.get(F.array(*(F.lit(x) for x in ("PT", "FN", "SY", "XX"))), (F.col("s_suppkey") % 4).cast("int"))
    target = lambda c: (F.lit(1_000_000) + F.col(c)).cast("string")
    atoms = part.select(cui("p_partkey").alias("cui"), F.lit("SRC").alias("sab"), F.lit("MH").alias("tty"), text("P", F.col("p_partkey")).alias("code"), F.col("p_name").alias("str"), F.col("p_partkey").alias("ord"))
    atoms = atoms.unionByName(supplier.select(far("s_suppkey").alias("cui"), F.lit("TGT").alias("sab"), tty.alias("tty"), target("s_suppkey").alias("code"), F.col("s_name").alias("str"), (F.col("s_suppkey") + 10**12).alias("ord")))
    rel = F.get(F.array(*(F.lit(x) for x in ("XX", "SY", "RQ", "RB", "RN", "XX", "XX", "XX"))), F.col("l_linenumber"))
    rels = lines.filter("l_quantity >= 40").select(cui("l_partkey").alias("cui1"), rel.alias("rel"), far("l_suppkey").alias("cui2"))
    sty = F.get(F.array(*(F.lit(x) for x in STY)), F.col("p_size") % 4)
    types = part.filter("p_size < 40").groupBy(cui("p_partkey").alias("cui"), sty.alias("sty")).agg(F.min("p_partkey").alias("ord"))
    curated = lines.filter("l_quantity >= 49").select(F.lit("M1").alias("mapset"), text("P", F.col("l_partkey")).alias("from_code"), target("l_suppkey").alias("to_code"))
    curated = curated.union(part.select(F.lit("M2"), text("P", F.col("p_partkey")), F.lit("not a code")))
    codes = part.select(text("P", F.col("p_partkey")).alias("code"))
    return M.map_codes(codes, atoms, rels, types, curated, C.type_roots(spark), "SRC", "TGT").select(*M.CANDIDATE)


@query("""WITH s AS (SELECT CAST(user_id AS VARCHAR) AS pmid, event_type || '-' || CAST(event_id AS VARCHAR) AS id, value FROM events WHERE value IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY pmid ORDER BY value DESC, id) AS rank, max(value) OVER (PARTITION BY pmid) AS top FROM s)
SELECT pmid, id, CAST(rank - 1 AS INTEGER) AS place, round(exp(value - top) / sum(exp(value - top)) OVER (PARTITION BY pmid), 6) AS score, 'none' AS last_type FROM k WHERE rank <= 10""")
def q56_solver_candidates(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").filter("value is not null")
    base = events.select(F.col("user_id").cast("string").alias("pmid"), F.lit(0).alias("idx"), F.lit("concept").alias("kind"), F.concat_ws("-", "event_type", F.col("event_id").cast("string")).alias("label"), F.col("value").alias("score"))
    types = events.groupBy(F.col("user_id").cast("string").alias("pmid"), F.lit(0).alias("idx"), F.lit("type").alias("kind"), F.col("event_type").alias("label")).agg(F.max("value").alias("score"))
    found = solver.top_candidates(base.unionByName(types))
    rows = found.select("pmid", F.element_at("types", -1)["label"].alias("last_type"), F.posexplode("concepts").alias("place", "c"))
    return rows.select("pmid", F.col("c.id").alias("id"), "place", F.round("c.score", 6).alias("score"), "last_type")


@query("SELECT count(DISTINCT l_orderkey) AS documents, count(DISTINCT l_orderkey) AS sat, CAST(0 AS BIGINT) AS fallback, CAST(1 AS DOUBLE) AS sat_rate FROM lineitem")
def q56b_solver_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Every order has a solution, since each line may be of either class and each pair has a relation that needs none."""
    solved = q45_constraint_solver(spark, sf).withColumn("elapsed_ms", F.lit(0.0))
    return metrics.solver_summary(solved).select("documents", "sat", "fallback", "sat_rate")
