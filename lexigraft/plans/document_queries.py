"""Document, feature, sampling and metric operators: orders are documents, their lines are entities, in line order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import documents as D
from ..operators import features as T
from ..operators import metrics, sampling, solver
from ..operators.passages import passage_offsets
from .base import query, table
from .mapping_queries import BEST, best

ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity"
LINES = f"lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1 AS pos FROM lineitem)"


def line_arrays(spark: SparkSession, sf: str, **fields: Column) -> DataFrame:
    """(doc, lines): each order's lines with the given fields, in line order."""
    order = [F.col(c.strip()) for c in ORDER.split(",")]
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.struct(*order, *(c.alias(f"_{n}") for n, c in fields.items())).alias("line"))
    grouped = lines.groupBy(F.col("l_orderkey").alias("doc")).agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return grouped.withColumn("lines", F.transform("lines", lambda x: F.struct(*(x[f"_{n}"].alias(n) for n in fields))))


@query(f"""WITH {LINES}, w AS (SELECT l_orderkey, pos, 'P' || CAST(l_partkey AS VARCHAR) AS word FROM lines),
s AS (SELECT *, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM w)
SELECT l_orderkey AS doc, string_agg(word, ' ' ORDER BY pos) AS text, string_agg(CAST(start AS VARCHAR) || '-' || CAST(start + length(word) AS VARCHAR), ',' ORDER BY pos) AS spans FROM s GROUP BY 1""")
def q21_doc_assembly(spark: SparkSession, sf: str) -> DataFrame:
    docs = line_arrays(spark, sf, word=F.concat(F.lit("P"), F.col("l_partkey").cast("string")))
    step = lambda s, x: F.struct((s["at"] + F.char_length(x["word"]) + 1).alias("at"), F.concat(s["out"], F.array(F.concat_ws("-", s["at"].cast("string"), (s["at"] + F.char_length(x["word"])).cast("string")))).alias("out"))
    spans = F.aggregate("lines", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step)["out"]
    return docs.select("doc", F.array_join(F.transform("lines", lambda x: x["word"]), " ").alias("text"), F.array_join(spans, ",").alias("spans"))


@query(BEST.rstrip() + """, m AS (SELECT code, sid AS target_id, conf, s_acctbal >= 0 AS ok FROM best JOIN supplier ON s_suppkey = sid),
p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
c AS (SELECT p.*, 0 AS part, m.* FROM p JOIN m ON code = l_partkey UNION ALL SELECT p.*, 1, m.* FROM p JOIN m ON code = l_suppkey),
first AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, conf DESC, part) = 1)
SELECT l_orderkey AS doc, CAST(l_partkey AS VARCHAR) || ',' || CAST(l_suppkey AS VARCHAR) AS code, CAST(target_id AS VARCHAR) AS mapped_id,
       round(CASE WHEN ok THEN conf ELSE conf * 0.5 END, 4) AS confidence, ok AS target_active FROM lineitem LEFT JOIN first USING (l_partkey, l_suppkey)""")
def q22_concept_stamp(spark: SparkSession, sf: str) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    code = F.concat_ws(",", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    docs = line_arrays(spark, sf, original_code=code, out_of_scope=F.lit(False), mapped_id=none("string"), mapping_confidence=none("double"), target_active=none("boolean")).withColumnRenamed("lines", "entities")
    active = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sid"), (F.col("s_acctbal") >= 0).alias("target_active"))
    mapped = best(spark, sf).join(active, "sid").select(F.col("code").cast("string").alias("code"), F.col("sid").cast("string").alias("target_id"), F.col("conf").alias("confidence"), "target_active")
    rows = D.stamp_concepts(docs, mapped).select("doc", F.explode("entities").alias("e"))
    return rows.select("doc", F.col("e.original_code").alias("code"), F.col("e.mapped_id").alias("mapped_id"), F.round("e.mapping_confidence", 4).alias("confidence"), F.col("e.target_active").alias("target_active"))


RELATIONS = [
    ("A", "F", "F", "1-URGENT", "causes", 2, 0.5, 0), ("A", "F", "F", "1-URGENT", "associated-with", 2, 0.5, 1), ("N", "O", "O", "2-HIGH", "due-to", 1, 0.3, 2),
    ("N", "O", "O", "2-HIGH", "treats", 2, 0.7, 3), ("R", "F", "P", "5-LOW", "converts-to", 2, 1.0, 4),
]
RELATION_VALUES = ", ".join(str(r) for r in RELATIONS)


@query(f"""WITH t(corpus, source, subject, object, target, tier, p, ord) AS (VALUES {RELATION_VALUES}),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY corpus, source, subject, object ORDER BY p DESC, ord) = 1)
SELECT coalesce(target, 'associated-with') AS target_relation, CAST(coalesce(tier, 2) AS INTEGER) AS tier, target IS NULL AS default_used, count(*) AS n
FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN b ON corpus = l_returnflag AND source = l_linestatus AND subject = o_orderstatus AND object = o_orderpriority GROUP BY ALL""")
def q23_relation_stamp(spark: SparkSession, sf: str) -> DataFrame:
    schema = "corpus string, source_relation_type string, subject_class string, object_class string, target_relation string, tier int, probability double, ord int"
    found = D.relation_candidates(spark.createDataFrame(RELATIONS, schema))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("subject_class"), F.col("o_orderpriority").alias("object_class"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("corpus"), F.col("l_linestatus").alias("source_relation_type"))
    rows = lines.join(orders, "l_orderkey").join(F.broadcast(found), ["corpus", "source_relation_type", "subject_class", "object_class"], "left")
    return rows.groupBy(
        F.coalesce("best.target_relation", F.lit(C.DEFAULT_RELATION)).alias("target_relation"), F.coalesce("best.tier", F.lit(C.DEFAULT_TIER)).alias("tier"), F.col("best").isNull().alias("default_used")
    ).agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, d AS (SELECT l_orderkey AS doc, list(CAST(l_partkey % 50 AS VARCHAR) ORDER BY pos) AS codes FROM lines GROUP BY 1)
SELECT doc, CAST(nullif(list_position(codes, codes[len(codes)]), 0) - 1 AS INTEGER) AS exact_idx, CAST(list_position(codes, codes[len(codes)]) - 1 AS INTEGER) AS part_idx FROM d""")
def q24_arg_resolution(spark: SparkSession, sf: str) -> DataFrame:
    docs = line_arrays(spark, sf, code=(F.col("l_partkey") % 50).cast("string")).withColumn("codes", F.transform("lines", lambda x: x["code"]))
    last = F.element_at("codes", -1)
    return docs.select("doc", D.first_index(F.col("codes"), last).alias("exact_idx"), D.first_index(F.col("codes"), F.concat(F.lit("none, "), last)).alias("part_idx"))


@query(f"""WITH {LINES}, bad AS (SELECT l_orderkey, pos, CASE WHEN l_returnflag = 'R' THEN 'no_verified_mapping' ELSE 'inactive_target' END AS cause FROM lines WHERE l_returnflag = 'R' OR l_linestatus = 'F'),
f AS (SELECT l_orderkey, cause FROM bad QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) = 1),
o AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'dev' WHEN o_orderpriority LIKE '2%' THEN 'test' ELSE 'train' END AS split FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))
SELECT split, 'orders' AS corpus, CASE WHEN split = 'train' THEN 'kept' ELSE coalesce(cause, 'kept') END AS cause, count(*) AS documents FROM o LEFT JOIN f ON o_orderkey = l_orderkey GROUP BY ALL""")
def q25_split_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = line_arrays(
        spark, sf, original_code=F.col("l_partkey").cast("string"), out_of_scope=F.lit(False), semantic_class=F.lit("chemical"),
        mapped_id=F.when(F.col("l_returnflag") != "R", F.col("l_suppkey").cast("string")), target_active=F.col("l_linestatus") != "F",
    ).withColumnRenamed("lines", "entities")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc"), "o_orderpriority", F.lit("orders").alias("corpus"))
    docs = docs.join(orders, "doc")
    first = F.substring("o_orderpriority", 1, 1)
    out = D.assemble_split([docs.filter(~first.isin("1", "2"))], "train", ("orders",), False)
    for split, digit in (("dev", "1"), ("test", "2")):
        out = out.unionByName(D.assemble_split([docs.filter(first == digit)], split, ("orders",), True))
    return D.split_audit(out)


@query("""
WITH p AS (SELECT user_id, count(DISTINCT event_type) AS codes FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1 HAVING count(DISTINCT event_type) = 2)
SELECT user_id, codes FROM p WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND event_type = 'signup' AND value > 100)""")
def q26_footprint_semijoin(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    mentions = events.select(F.col("user_id").alias("pmid"), F.col("event_type").alias("code"), F.when(F.col("event_type") == "purchase", "chemical").otherwise("disease").alias("semantic_class"))
    wanted = spark.createDataFrame([("purchase", "chemical"), ("error", "disease")], "code string, semantic_class string")
    found = sampling.in_domain(mentions, F.broadcast(wanted)).groupBy(F.col("pmid").alias("user_id")).agg(F.count("*").alias("codes"))
    return found.join(events.filter("event_type = 'signup' and value > 100").select("user_id"), "user_id", "left_anti")


TAGS = "CASE event_type WHEN 'click' THEN 'B-c' WHEN 'purchase' THEN 'I-c' WHEN 'error' THEN 'B-d' WHEN 'signup' THEN 'I-d' ELSE 'O' END"


@query(f"""WITH t AS (SELECT user_id AS doc, event_id AS pos, {TAGS} AS tag FROM events),
n AS (SELECT *, lag(tag) OVER (PARTITION BY doc ORDER BY pos) AS before FROM t),
r AS (SELECT doc, pos, tag, sum(CASE WHEN tag LIKE 'I-%' AND before IS NOT NULL AND before <> 'O' AND substr(before, 3) = substr(tag, 3) THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos) AS run FROM n)
SELECT doc, min(pos) AS first, max(pos) AS last, min(substr(tag, 3)) AS semantic_class FROM r WHERE tag <> 'O' GROUP BY doc, run""")
def q32_bio_decode(spark: SparkSession, sf: str) -> DataFrame:
    tag = F.element_at(F.create_map(*(F.lit(x) for x in ("click", "B-c", "purchase", "I-c", "error", "B-d", "signup", "I-d", "view", "O"))), F.col("event_type"))
    return T.bio_decode(table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.coalesce(tag, F.lit("O")).alias("tag")))


@query("""
WITH b AS (SELECT word, min(item_id) % 2 AS odd FROM (SELECT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark) WHERE length(word) >= 8 GROUP BY word),
w AS (SELECT doc_id AS doc, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
h AS (SELECT doc, pos AS f, CASE WHEN odd = 0 AND length(lead(token) OVER (PARTITION BY doc ORDER BY pos)) > 0 THEN pos + 1 ELSE pos END AS l, word, CASE odd WHEN 0 THEN 'gene' ELSE 'disease' END AS cls FROM w LEFT JOIN b ON word = token),
x AS (SELECT doc, f, cls, unnest(generate_series(f, l)) AS pos FROM h WHERE word IS NOT NULL),
t AS (SELECT doc, pos, CASE WHEN pos = f THEN 'B-' ELSE 'I-' END || cls AS tag FROM x QUALIFY row_number() OVER (PARTITION BY doc, pos ORDER BY f DESC) = 1)
SELECT doc, coalesce(tag, 'O') AS tag, count(*) AS n FROM w LEFT JOIN t USING (doc, pos) GROUP BY ALL""")
def q33_bio_align(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark found in whole documents are entities, some of them with the word after."""
    items = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", " ", -1)).alias("token")).filter("char_length(token) >= 8")
    known = items.groupBy("token").agg((F.min("item_id") % 2).alias("odd"))
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", " ", -1)).alias("pos", "token"))
    rows = passage_offsets(words, "doc", "pos", "token").select("doc", "pos", "token", "start", (F.col("start") + F.char_length("token")).alias("end"), F.lit(1).alias("mask"))
    after = F.lead("end").over(Window.partitionBy("doc").orderBy("pos"))
    entities = rows.withColumn("after", after).join(known, "token").select(
        "doc", F.col("pos").alias("ord"), F.col("start").alias("span_start"), F.when((F.col("odd") == 0), F.coalesce("after", "end")).otherwise(F.col("end")).alias("span_end"), F.when(F.col("odd") == 0, "gene").otherwise("disease").alias("semantic_class")
    )
    return T.bio_align(rows.drop("token"), entities).groupBy("doc", "tag").agg(F.count("*").alias("n"))


def brand_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_brand").alias("concept_id"), F.concat("p_name", F.lit(" (x)")).alias("term"), F.lit("1").alias("active"))


def brands(spark: SparkSession, sf: str) -> DataFrame:
    return T.synonym_rows(brand_names(spark, sf))


def several(spark: SparkSession, sf: str) -> DataFrame:
    """The terms of brands that have several."""
    rows = brands(spark, sf)
    return rows.join(T.synonym_counts(rows).select("concept_id"), "concept_id", "left_semi")


TERMS = "t AS (SELECT DISTINCT p_brand AS concept_id, p_name AS term FROM part), g AS (SELECT concept_id, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 2)"


@query(f"""WITH {TERMS}, r AS (SELECT t.*, row_number() OVER (PARTITION BY concept_id ORDER BY substr(md5(term), 1, 3), term) - 1 AS i FROM t JOIN g USING (concept_id)),
p AS (SELECT x.concept_id, x.term AS a, y.term AS b, y.i * (y.i - 1) // 2 + x.i AS m FROM r x JOIN r y ON x.concept_id = y.concept_id AND x.i < y.i),
d AS (SELECT concept_id, CAST((CAST('0x' || substr(md5(concept_id || '|0'), 1, 8) AS BIGINT) + k * 2147483647) % (n * (n - 1) // 2) AS BIGINT) AS m FROM g CROSS JOIN range(50) s(k) WHERE k < n * (n - 1) // 2)
SELECT concept_id, a, b FROM p JOIN d USING (concept_id, m)""")
def q34_synonym_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return T.synonym_pairs(brands(spark, sf), 50)


@query(f"""WITH {LINES}, e AS (SELECT DISTINCT l_orderkey AS doc, pos AS idx FROM lines),
p AS (SELECT l_orderkey AS doc, pos AS i, pos + 1 AS j, l_returnflag AS label, l_discount AS prob FROM lines WHERE pos % 2 = 0 AND EXISTS (SELECT 1 FROM e WHERE doc = l_orderkey AND idx = pos + 1)),
c AS (SELECT doc, count(*) AS p FROM p GROUP BY 1),
n AS (SELECT e.doc, e.idx AS i, f.idx AS j, greatest(least(2 * c.p, 8 - c.p), 0) AS room FROM e JOIN c USING (doc) JOIN e f ON f.doc = e.doc AND f.idx <> e.idx WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc = e.doc AND p.i = e.idx AND p.j = f.idx)),
k AS (SELECT doc, i, j FROM n QUALIFY row_number() OVER (PARTITION BY doc ORDER BY md5(CAST(doc AS VARCHAR) || '|' || CAST(i AS VARCHAR) || '|' || CAST(j AS VARCHAR) || '|0'), i, j) <= room)
SELECT doc, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, label, prob AS weight FROM p UNION ALL SELECT doc, CAST(i AS INTEGER), CAST(j AS INTEGER), 'no-relation', 1.0 FROM k""")
def q34b_entity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    lines = line_arrays(spark, sf, label=F.col("l_returnflag"), p=F.col("l_discount")).select("doc", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "x"))
    positives = lines.filter("i % 2 = 0 and i + 1 < n").select("doc", "i", (F.col("i") + 1).alias("j"), F.col("x.label").alias("label"), F.col("x.p").alias("probability"), F.col("i").alias("ord"))
    return T.entity_pairs(lines.select("doc", F.col("i").alias("idx")), positives, 2.0, 8)


@query(f"WITH {TERMS} SELECT concept_id, n AS terms, least(n * (n - 1) // 2, 50) AS budget FROM g")
def q35_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("terms")
    return T.synonym_counts(brands(spark, sf)).select("concept_id", n.alias("terms"), F.least(F.floor(n * (n - 1) / 2), F.lit(50).cast("long")).alias("budget"))


@query(f"WITH {TERMS} SELECT CAST(sum(least(n * (n - 1) // 2, 50)) AS BIGINT) AS pairs FROM g")
def q35b_pair_budget(spark: SparkSession, sf: str) -> DataFrame:
    return T.pair_budget(T.synonym_counts(brands(spark, sf)), 50)


@query("""SELECT p_brand AS concept_id, coalesce(min_by(p_name, p_partkey) FILTER (p_size < 5), min_by(p_name, p_partkey) FILTER (p_size >= 5)) AS term FROM part GROUP BY 1""")
def q35c_preferred_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("concept_id"), F.concat("p_name", F.when(F.col("p_size") < 5, " (x)").otherwise("")).alias("term"), F.when(F.col("p_size") < 5, "F").otherwise("S").alias("type_id"), F.lit("1").alias("active"), F.col("p_partkey").alias("ord"))
    return T.preferred_terms(rows, "F", "S")


@query("""
WITH p AS (SELECT doc_id, CASE WHEN n_chars >= 1500 THEN 1 ELSE 0 END AS cls FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)), g AS (SELECT doc_id, quality AS cls FROM labels),
j AS (SELECT p.doc_id IS NOT NULL AS hp, g.doc_id IS NOT NULL AS hg FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.cls = g.cls),
c AS (SELECT count(*) FILTER (hp AND hg) AS tp, count(*) FILTER (hp AND NOT hg) AS fp, count(*) FILTER (hg AND NOT hp) AS fn FROM j)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def q36_span_f1(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    predicted = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.when(F.col("n_chars") >= 1500, 1).otherwise(0).alias("cls"))
    out = metrics.span_f1(predicted, labels.select("doc_id", F.col("quality").alias("cls")), ["doc_id", "cls"])
    return out.select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""
WITH r AS (SELECT l_returnflag AS predicted, CASE WHEN l_linestatus = 'F' THEN 'A' ELSE 'N' END AS gold FROM lineitem), l(label) AS (VALUES ('A'), ('N'), ('R'), ('X')),
c AS (SELECT label, count(*) FILTER (predicted = label AND gold = label) AS tp, count(*) FILTER (predicted = label AND gold <> label) AS fp, count(*) FILTER (gold = label AND predicted <> label) AS fn FROM l CROSS JOIN r GROUP BY 1)
SELECT round(avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1 FROM c""")
def q36b_macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("predicted"), F.when(F.col("l_linestatus") == "F", "A").otherwise("N").alias("gold"))
    return metrics.macro_f1(rows, ["A", "N", "R", "X"]).select(F.round("macro_f1", 6).alias("macro_f1"))


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations")
def q42_passage_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return passage_offsets(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.col("start").cast("long").alias("start"))


@query("""SELECT page_id, nullif(regexp_extract(url, '^https?://([^/:?#]+)', 1), '') AS host, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title,
CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS links FROM pages""")
def q43_page_tokens(spark: SparkSession, sf: str) -> DataFrame:
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    links = F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)))
    return table(spark, sf, "pages").select("page_id", found("url", r"^https?://([^/:?#]+)").alias("host"), found("html", "<title>([^<]*)</title>").alias("title"), links.alias("links"))


COVER = "r AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS pmid, event_type || '-' || CAST(event_id % 37 AS VARCHAR) AS code FROM events), n AS (SELECT pmid, count(*) AS richness FROM r GROUP BY 1)"


@query(f"""WITH {COVER}, k AS (SELECT pmid, richness, row_number() OVER (PARTITION BY code ORDER BY richness DESC, pmid) AS place FROM r JOIN n USING (pmid)),
h AS (SELECT pmid, max(richness) AS richness, CAST(CASE WHEN min(place) <= 3 THEN 1 ELSE 2 END AS INTEGER) AS phase FROM k GROUP BY 1)
SELECT pmid, phase, richness FROM h ORDER BY phase, richness DESC, pmid LIMIT 25000""")
def q44_set_cover(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("pmid"), F.concat_ws("-", "event_type", (F.col("event_id") % 37).cast("string")).alias("code"))
    return sampling.set_cover(rows)


def solved_orders(spark: SparkSession, sf: str, relations: tuple[tuple[str, float], ...]) -> DataFrame:
    """Orders as documents: lines are entities with two types and two concepts, neighbours are pairs with these relations."""
    chemical, disease = F.lit("chemical"), F.lit("disease")
    score = lambda x: x["discount"] * 5 + 0.3
    label = lambda x, yes, no: F.when(x["flag"] == "R", yes).otherwise(no)
    types = lambda x: F.array(F.struct(label(x, disease, chemical).alias("label"), score(x).alias("score")), F.struct(label(x, chemical, disease).alias("label"), (F.lit(1.0) - score(x)).alias("score")))
    concepts = lambda x: F.array(F.struct((x["part"] % 100).cast("string").alias("id"), F.lit(0.6).alias("score")), F.struct((x["supplier"] % 100).cast("string").alias("id"), F.lit(0.4).alias("score")))
    # lines are shuffled as they are and described in their order's row
    docs = line_arrays(spark, sf, part=F.col("l_partkey"), supplier=F.col("l_suppkey"), flag=F.col("l_returnflag"), discount=F.col("l_discount"))
    docs = docs.select("doc", F.transform("lines", lambda x: F.struct(types(x).alias("types"), concepts(x).alias("concepts"))).alias("entities"))
    candidates = F.array(*(F.struct(F.lit(label).alias("label"), F.lit(points).alias("score")) for label, points in relations))
    pairs = F.when(F.size("entities") > 1, F.transform(F.sequence(F.lit(0), F.size("entities") - 2), lambda i: F.struct(i.alias("i"), (i + 1).alias("j"), candidates.alias("relations")))).otherwise(F.array().cast("array<struct<i: int, j: int, relations: array<struct<label: string, score: double>>>>"))
    ids = spark.range(100).select(F.when(F.col("id") % 3 == 0, chemical).otherwise(disease).alias("semantic_class"), F.col("id").cast("string").alias("concept"))
    valid = spark.createDataFrame([("causative-agent", a, b, (a, b) == ("disease", "chemical")) for a in ("chemical", "disease") for b in ("chemical", "disease")], "relation string, subject_class string, object_class string, valid boolean")
    return solver.solve_documents(docs.select(F.col("doc").cast("string").alias("pmid"), "entities", pairs.alias("pairs")), ids, valid)


@query(f"""WITH RECURSIVE {LINES}, o(label, third) AS (VALUES ('chemical', true), ('disease', false)),
x AS (SELECT l_orderkey AS doc, pos, label, CASE WHEN (l_returnflag = 'R') = (label = 'disease') THEN 0 ELSE 1 END AS t, l_discount * 5 + 0.3 AS score, l_partkey % 100 AS p, l_suppkey % 100 AS s, (l_partkey % 100 % 3 = 0) = third AS fits_p, (l_suppkey % 100 % 3 = 0) = third AS fits_s FROM lines CROSS JOIN o),
c AS (SELECT doc, pos, label, t, CAST(CASE WHEN fits_p THEN p ELSE s END AS VARCHAR) AS concept, CASE WHEN fits_p THEN 0 ELSE 1 END AS changed,
  CAST(round(CASE WHEN t = 0 THEN score ELSE 1.0 - score END * 1000) AS BIGINT) + CASE WHEN fits_p THEN 600 ELSE 400 END AS gain FROM x WHERE fits_p OR fits_s),
w AS (SELECT doc, pos, label, CAST(t AS VARCHAR) AS path, gain AS score, changed AS overrides, '{{"type":"' || label || '","concept":"' || concept || '"}}' AS entities, CAST('' AS VARCHAR) AS pairs FROM c WHERE pos = 0
  UNION ALL SELECT w.doc, c.pos, c.label, path || CAST(t AS VARCHAR), score + gain + CASE WHEN w.label = 'disease' AND c.label = 'chemical' THEN 700 ELSE 600 END, overrides + changed,
    entities || ',{{"type":"' || c.label || '","concept":"' || concept || '"}}',
    pairs || CASE WHEN c.pos > 1 THEN ',' ELSE '' END || '{{"i":' || CAST(w.pos AS VARCHAR) || ',"j":' || CAST(c.pos AS VARCHAR) || ',"relation":"' || CASE WHEN w.label = 'disease' AND c.label = 'chemical' THEN 'causative-agent' ELSE 'associated-with' END || '"}}'
  FROM w JOIN c ON c.doc = w.doc AND c.pos = w.pos + 1),
n AS (SELECT l_orderkey AS doc, max(pos) AS pos FROM lines GROUP BY 1)
SELECT CAST(doc AS VARCHAR) AS pmid, 'sat' AS status, score, CAST(overrides AS INTEGER) AS overrides, '[' || entities || ']' AS entities, '[' || pairs || ']' AS pairs FROM w JOIN n USING (doc, pos)
QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, path) = 1""")
def q45_constraint_solver(spark: SparkSession, sf: str) -> DataFrame:
    """Solve every order as a document."""
    solved = solved_orders(spark, sf, (("causative-agent", 0.7), ("associated-with", 0.6)))
    return solved.select("pmid", "status", "score", "overrides", F.to_json("entities").alias("entities"), F.to_json("pairs").alias("pairs"))


@query(f"""WITH {LINES}, o(label, third) AS (VALUES ('chemical', true), ('disease', false)),
x AS (SELECT l_orderkey AS doc, pos, label, CASE WHEN (l_returnflag = 'R') = (label = 'disease') THEN 0 ELSE 1 END AS t, l_discount * 5 + 0.3 AS score, l_partkey % 100 AS p, l_suppkey % 100 AS s, (l_partkey % 100 % 3 = 0) = third AS fits_p, (l_suppkey % 100 % 3 = 0) = third AS fits_s FROM lines CROSS JOIN o),
c AS (SELECT doc, pos, label, t, CAST(CASE WHEN fits_p THEN p ELSE s END AS VARCHAR) AS concept, CASE WHEN fits_p THEN 0 ELSE 1 END AS changed,
  CAST(round(CASE WHEN t = 0 THEN score ELSE 1.0 - score END * 1000) AS BIGINT) + CASE WHEN fits_p THEN 600 ELSE 400 END AS gain FROM x WHERE fits_p OR fits_s),
n AS (SELECT l_orderkey AS doc, count(*) AS n FROM lines GROUP BY 1),
one AS (SELECT c.doc, gain AS score, changed AS overrides, label || ':' || concept AS chosen FROM c JOIN n USING (doc) WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY gain DESC, t) = 1),
two AS (SELECT a.doc, a.gain + b.gain + 700 AS score, a.changed + b.changed AS overrides, a.label || ':' || a.concept || ',' || b.label || ':' || b.concept AS chosen
  FROM c a JOIN c b ON b.doc = a.doc AND b.pos = 1 AND b.label = 'chemical' JOIN n ON n.doc = a.doc WHERE n = 2 AND a.pos = 0 AND a.label = 'disease'),
sat AS (SELECT * FROM one UNION ALL SELECT * FROM two),
firsts AS (SELECT l_orderkey AS doc, string_agg(CASE l_returnflag WHEN 'R' THEN 'disease' ELSE 'chemical' END || ':' || CAST(l_partkey % 100 AS VARCHAR), ',' ORDER BY pos) AS chosen FROM lines GROUP BY 1)
SELECT CAST(doc AS VARCHAR) AS pmid, CASE WHEN score IS NULL THEN 'fallback' ELSE 'sat' END AS status, score, CAST(coalesce(overrides, 0) AS INTEGER) AS overrides, coalesce(sat.chosen, firsts.chosen) AS chosen FROM firsts LEFT JOIN sat USING (doc)""")
def q45b_no_solution(spark: SparkSession, sf: str) -> DataFrame:
    """A relation that holds only from a disease to a chemical: orders of three lines have no solution and fall back to first candidates."""
    solved = solved_orders(spark, sf, (("causative-agent", 0.7),))
    return solved.select("pmid", "status", "score", "overrides", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["type"], e["concept"])), ",").alias("chosen"))
GRAMS = "(((CAST(unicode(text[i]) AS BIGINT) * 1000003 + unicode(text[i + 1])) % 2147483647 * 1000003 + unicode(text[i + 2])) % 2147483647) % 32"


@query(f"""WITH n AS (SELECT p_partkey, ' ' || lower(p_name) || ' ' AS text FROM part), p AS (SELECT p_partkey, text, unnest(generate_series(1, length(text) - 2)) AS i FROM n)
SELECT p_partkey, CAST({GRAMS} AS INTEGER) AS dim, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY ALL""")
def q46_term_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed n-gram vectors of part names, what isn't zero of them: the fixed stand-in for a term encoder."""
    from ..functions.text import hashed_ngrams

    return table(spark, sf, "part").select("p_partkey", F.posexplode(hashed_ngrams(F.col("p_name"), 3, 32)).alias("dim", "value")).filter("value > 0")
