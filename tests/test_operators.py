"""Operators on small fixtures, one for each trap, against values worked out by hand or by exhaustive search."""

import itertools
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigraft import plans
from lexigraft.functions import constants as C
from lexigraft.functions import text as X
from lexigraft.operators import constraints, documents, features, hierarchy, kg, mapping, metrics, sampling, silver, soft, solver


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_codes(spark):
    code = X.normalise_code(F.col("c"))
    got = {c: one(spark, code, c=c) for c in (" MESH:D000001 ", "C123456", "D000077588", "-", "", "-1", "x", None)}
    assert got == {" MESH:D000001 ": "D000001", "C123456": "C123456", "D000077588": None, "-": None, "": None, "-1": None, "x": None, None: None}
    assert one(spark, X.split_composite(F.col("c")), c=" a,;b| ,c") == ["a", "b", "c"]
    assert one(spark, X.strip_prefix(F.col("c"), any_case=True), c="mesh:D1 ") == "D1"
    assert one(spark, X.strip_prefix(F.col("c")), c="mesh:D1") == "mesh:D1"
    assert one(spark, X.role_code(F.col("c")), c="Chemical|MESH:D1|x") == "MESH:D1|x"
    assert one(spark, X.strip_suffix(F.col("c")), c="a (b) (c)") == "a (b)"


def test_expressions(spark):
    text = "<< 404684003 |Clinical finding| MINUS < 64572001 OR 123456 : 246075003 = <<105590001"
    assert one(spark, X.expression_roots(F.col("c")), c=text) == ["404684003", "64572001", "123456", "246075003", "105590001"]
    assert [t.op for t in one(spark, X.expression_tokens(F.col("c")), c=text)] == ["<<", "<", "=", "=", "<<"]


def test_softmax(spark):
    got = spark.sql("SELECT array(0.1D, 0.2D, 0.2D) a").select(X.softmax(F.col("a"), 0.05).alias("x")).first().x
    assert abs(sum(got) - 1) < 1e-12 and got[1] == got[2] > got[0]


def test_constants(spark):
    table = C.RELATION_MAPPINGS
    assert len(table) == 108 and len({t[:4] for t in table}) == 66 and sum(t[5] == 1 for t in table) == 15
    sums = Counter()
    for t in table:
        sums[t[:4]] += t[6]
    assert all(abs(v - 1) < 1e-9 for v in sums.values())
    assert len(C.bio_labels()) == len(C.relation_labels()) == 13


@pytest.fixture
def vocabulary(spark):
    atoms = [
        ("K1", "SRC", "MH", "A1", "alpha", 0), ("K2", "SRC", "MH", "A2", "beta", 1), ("K3", "SRC", "MH", "A3", "gamma", 2), ("K4", "SRC", "MH", "A4", "delta", 3), ("K5", "SRC", "MH", "A5", "omega", 4),
        ("K1", "TGT", "SY", "1000002", "longer alpha", 5), ("K1", "TGT", "PT", "1000001", "alpha", 6), ("K2", "TGT", "SY", "2000002", "beta", 7), ("K2", "TGT", "SY", "2000001", "beta", 8), ("K9", "TGT", "PT", "3000001", "near", 9),
    ]
    return {
        "atoms": spark.createDataFrame(atoms, "cui string, sab string, tty string, code string, str string, ord long"),
        "rels": spark.createDataFrame([("K3", "RB", "K9", 0), ("K3", "SY", "K9", 1), ("K5", "PAR", "K9", 2)], "cui1 string, rel string, cui2 string, ord long"),
        "types": spark.createDataFrame([("K4", "Finding", 0), ("K4", "Sign or Symptom", 1), ("K4", "Hormone", 2)], "cui string, sty string, ord long"),
        "curated": spark.createDataFrame([("MAP", "A1", "9000001", 0), ("MAP", "A1", "12", 1)], "mapset string, from_code string, to_code string, ord long"),
        "codes": spark.createDataFrame([(f"A{i}",) for i in range(1, 7)], "code string"),
    }


def test_tiers(spark, vocabulary):
    v = vocabulary
    got = mapping.map_codes(v["codes"], v["atoms"], v["rels"], v["types"], v["curated"], C.type_roots(spark), "SRC", "TGT")
    found = {r.code: (r.target_id, r.confidence, r.tier, r.method) for r in got.collect()}
    assert found["A1"] == ("9000001", 0.95, 1, "curated:MAP")
    assert found["A2"] == ("2000001", 0.90, 2, "shared:K2")
    assert found["A3"] == ("3000001", 0.70, 3, "hop:SY")
    assert found["A4"] == ("105590001", 0.40, 4, "type:Hormone") and set(found) == {"A1", "A2", "A3", "A4"}
    left = mapping.unmapped(v["codes"], got, v["atoms"].filter("sab = 'SRC'"))
    assert rows(left, "code", "reason") == [("A5", "no_path"), ("A6", "no_evidence")]


@pytest.fixture
def dag(spark):
    pairs = [("t1", "root"), ("t2", "root"), ("a", "t1"), ("b", "a"), ("b", "t2"), ("c", "b")]
    return spark.createDataFrame([(c, p, i) for i, (c, p) in enumerate(pairs)], "child string, parent string, ord long")


def test_hierarchy(spark, dag):
    seeds = spark.createDataFrame([("c",), ("lonely",)], "id string")
    assert rows(hierarchy.closure(dag, seeds), "reached", "hops") == [("a", 2), ("b", 1), ("root", 3), ("t1", 3), ("t2", 2)]
    assert dict(rows(hierarchy.depths(dag, "root"), "id", "depth")) == {"root": 0, "t1": 1, "t2": 1, "a": 2, "b": 2, "c": 3}
    assert {r.id: (r.tops, r.semantic_type) for r in hierarchy.memberships(dag, "root").collect()}["c"] == (["t1", "t2"], "t1")
    near = hierarchy.neighbourhood(dag, spark.createDataFrame([("b",)], "id string"))
    assert rows(near, "rank", "id", "hops") == [(1, "b", 0), (2, "a", 1), (3, "t2", 1), (4, "t1", 2), (5, "root", 2), (6, "c", 1)]
    assert dict(rows(hierarchy.descendant_counts(dag, spark.createDataFrame([("t1",), ("c",)], "id string")), "id", "descendants")) == {"t1": 3, "c": 0}
    loop = dag.union(spark.createDataFrame([("t1", "c", 9)], dag.schema))
    assert hierarchy.cycle_nodes(dag).count() == 0 and ("a",) in rows(hierarchy.cycle_nodes(loop), "id")
    with pytest.raises(ValueError, match="cycle"):
        hierarchy.closure(loop, seeds)


def test_lin(spark, dag):
    node = hierarchy.nodes(dag.select(F.col("child").alias("id"), F.lit("1").alias("active")), dag)
    ic = hierarchy.information_content(hierarchy.descendant_counts(dag, node), node.count())
    pairs = spark.createDataFrame([("a", "b"), ("a", "t2"), ("c", "c")], "a string, b string")
    got = {(r.a, r.b): r.lin for r in hierarchy.lin_similarity(pairs, hierarchy.closure(dag, node), ic).collect()}
    assert got[("c", "c")] == 1.0 and got[("a", "t2")] == 0.0 and 0 < got[("a", "b")] < 1


def test_descriptions(spark):
    data = [("1", "S", "plain", 0), ("1", "F", "full (x)", 1), ("1", "F", "later (y)", 2), ("2", "S", "synonym (kept)", 0), ("2", "F", "full (z)", 1)]
    df = spark.createDataFrame(data, "concept_id string, type_id string, term string, ord long").withColumn("active", F.lit("1"))
    need = spark.createDataFrame([("1",), ("2",)], "id string")
    assert rows(constraints.descriptions(df, need, "F"), "id", "term") == [("1", "full (x)"), ("2", "synonym (kept)")]


def test_rules(spark):
    domains = spark.createDataFrame([("D1", "<< 404684003", "1"), ("D2", "", "1")], "referenced_id string, domain_constraint string, active string")
    attributes = spark.createDataFrame([("246075003", "D1", "1", "0..1", "723597001", "x", "1", 0)], "referenced_id string, domain_id string, grouped string, cardinality string, rule_strength_id string, content_type_id string, active string, ord long")
    ranges = spark.createDataFrame([("246075003", "<< 105590001", "723598006", "723596005", "1", 0), ("R2", "123456", "a", "b", "1", 1)], "referenced_id string, range_constraint string, rule_strength_id string, content_type_id string, active string, ord long")
    names = spark.createDataFrame([("246075003", "Causative agent")], "id string, term string")
    rules = constraints.attribute_rules(attributes, ranges, constraints.domain_rules(domains), names)
    got = {r.attribute: r for r in rules.collect()}
    assert got["246075003"].domains[0].strength == "Mandatory CM rule" and got["246075003"].domains[0].content == "x" and got["R2"].domains is None
    assert ("123456",) in rows(constraints.anchors(rules), "id")
    below = spark.createDataFrame([("404684003", "64572001")], "start string, reached string")
    valid = {tuple(r)[:3]: r.valid for r in constraints.valid_pairs(constraints.relation_constraints(rules), below).collect()}
    assert valid[("causative-agent", "disease", "chemical")] and not valid[("causative-agent", "chemical", "disease")]


def test_relation_ties_and_default(spark):
    best = {tuple(r)[:4]: r.best.target_relation for r in documents.relation_candidates(C.relation_table(spark)).select("corpus", "source_relation_type", "subject_class", "object_class", "best").collect()}
    assert best[("BioRED", "Positive_Correlation", "gene", "gene")] == "causes"
    assert best[("BC5CDR", "CID", "chemical", "disease")] == "causes"


def test_set_cover_is_the_greedy_one(spark):
    rng = random.Random(5)
    pairs = sorted({(f"p{rng.randrange(60):02d}", f"c{rng.randrange(25)}") for _ in range(260)})
    by = {}
    for p, c in pairs:
        by.setdefault(p, set()).add(c)
    for size, target in ((1000, 3), (12, 2)):
        order, count, taken = sorted(by, key=lambda p: (-len(by[p]), p)), Counter(), []
        for p in order:
            if len(taken) < size and any(count[c] < target for c in by[p]):
                taken.append(p)
                count.update(by[p])
        for p in order:
            if len(taken) < size and p not in taken:
                taken.append(p)
        got = sampling.set_cover(spark.createDataFrame(pairs, "pmid string, code string"), size, target)
        assert sorted(r.pmid for r in got.collect()) == sorted(taken)


def test_solver_is_exhaustive():
    rng = random.Random(2)
    classes, checked = ["chemical", "disease"], {"causative-agent"}
    valid = {("causative-agent", "disease", "chemical")}
    under = {(c, str(k)) for c in classes for k in range(6) if rng.random() < 0.5}
    for _ in range(60):
        n = rng.randrange(1, 4)
        entities = [{"types": [{"label": t, "score": rng.random()} for t in rng.sample(classes, 2)], "concepts": [{"id": str(rng.randrange(6)), "score": rng.random()} for _ in range(2)]} for _ in range(n)]
        pairs = [{"i": i, "j": i + 1, "relations": [{"label": r, "score": rng.random()} for r in ("causative-agent", "treats")[: rng.randrange(1, 3)]]} for i in range(n - 1)]
        best = None
        for ts in itertools.product(range(2), repeat=n):
            for cs in itertools.product(range(2), repeat=n):
                if any((entities[i]["types"][ts[i]]["label"], entities[i]["concepts"][cs[i]]["id"]) not in under for i in range(n)):
                    continue
                for rs in itertools.product(*(range(len(p["relations"])) for p in pairs)):
                    labels = [p["relations"][k]["label"] for p, k in zip(pairs, rs, strict=True)]
                    kind = [entities[i]["types"][ts[i]]["label"] for i in range(n)]
                    if any(x in checked and (x, kind[p["i"]], kind[p["j"]]) not in valid for x, p in zip(labels, pairs, strict=True)):
                        continue
                    total = sum(solver.scaled(entities[i]["types"][ts[i]]["score"]) + solver.scaled(entities[i]["concepts"][cs[i]]["score"]) for i in range(n)) + sum(solver.scaled(p["relations"][k]["score"]) for p, k in zip(pairs, rs, strict=True))
                    best = total if best is None else max(best, total)
        got = solver.solve(entities, pairs, under, set(classes), valid, checked)
        assert (got["score"] if got else None) == best


def test_insert_ignore_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 1), ("a", "x", 1), ("a", "x", 2)], "k string, d string, v int")
    assert rows(kg.insert_ignore(df, ["k", "d"]), "v", "k") == [(1, "a"), (1, "a"), (1, "a")]


def test_soft_boost(spark):
    base = spark.createDataFrame([("A", "1", 0.6), ("A", "2", 0.4), ("B", "3", 1.0)], "code string, target_id string, prob double")
    counts = spark.createDataFrame([("A", "2", 3), ("A", "1", 1), ("B", "9", 1), ("Z", "1", 1)], "code string, target_id string, votes long")
    got = {tuple(r)[:2]: round(r.prob, 6) for r in soft.boost(base, counts).collect()}
    assert got == {("A", "1"): round(0.6 / 1.4, 6), ("A", "2"): round(0.8 / 1.4, 6), ("B", "3"): round(1 / 1.5, 6), ("B", "9"): round(0.5 / 1.5, 6)}


def test_bio(spark):
    tokens = spark.createDataFrame([(1, i, 4 * i, 4 * i + 3, 1) for i in range(5)] + [(1, 5, 0, 0, 1)], "doc int, pos int, start int, `end` int, mask int")
    entities = spark.createDataFrame([(1, 0, 0, 7, "gene"), (1, 1, 5, 11, "disease")], "doc int, ord int, span_start int, span_end int, semantic_class string")
    tags = features.bio_align(tokens, entities)
    assert [t for _, t in rows(tags, "pos", "tag")] == ["B-gene", "B-disease", "I-disease", "O", "O", "O"]
    odd = spark.createDataFrame([(1, 0, "I-gene"), (1, 1, "I-gene"), (1, 2, "I-disease"), (1, 3, "O"), (1, 4, "B-gene")], "doc int, pos int, tag string")
    assert rows(features.bio_decode(odd), "first", "last", "semantic_class") == [(0, 1, "gene"), (2, 2, "disease"), (4, 4, "gene")]


def test_tokens_are_where_they_say(spark):
    text = " Ab, cd-ef!  x"
    got = features.tokens(spark.createDataFrame([(1, text), (2, "")], "doc int, text string"))
    assert [(text[r.start : r.end], r.token) for r in got.filter("doc = 1").orderBy("pos").collect()] == [(t, t) for t in ["Ab", ",", "cd", "-", "ef", "!", "x"]]


def test_bulk(spark):
    data = [("1", "treat", "Chemical|MESH:D1", "Disease|MESH:D2", 0), ("1", "x", "Gene|1", "Disease|D2", 1), ("2", "cause", "Chemical|D1", "Disease|-", 2), ("3", "cause", "Chemical|D1", "Disease|D3", 3), ("1", "cause", "Chemical|D1", "Disease|D2", 4)]
    bulk = spark.createDataFrame(data, "pmid string, relation string, subject string, object string, ord long")
    gold = spark.createDataFrame([("9",)], "pmid string")
    assert rows(silver.bulk_relations(bulk, gold, 1), "pmid", "relation") == [("1", "treat")]
    relations = silver.bulk_relations(bulk, gold)
    mentions = silver.bulk_mentions(spark.createDataFrame([("1", "MESH:D1", " |x", 0), ("1", "D1", "asp|y", 1), ("1", "D2", "ill", 2)], "pmid string, code string, mentions string, ord long"), relations)
    mapped = spark.createDataFrame([("D1", "100", 0.9)], "code string, target_id string, confidence double")
    docs = silver.bulk_documents(relations, mentions, mapped).collect()
    assert [(d.text, d.text[e.span_start : e.span_end]) for d in docs for e in d.entities][:2] == [("asp causes ill", "asp"), ("asp causes ill", "ill")]
    assert round(docs[0].entities[0].mapping_confidence, 6) == 0.36


def test_bulk_relations_are_not_capped(spark, monkeypatch):
    data = [(str(i), "treat", "Chemical|D1", "Disease|D2", i) for i in range(5)]
    bulk, gold = spark.createDataFrame(data, "pmid string, relation string, subject string, object string, ord long"), spark.createDataFrame([("9",)], "pmid string")
    assert silver.bulk_relations(bulk, gold, None).count() == 5 and silver.bulk_relations(bulk, gold, 2).count() == 2
    monkeypatch.setattr(silver.bulk_relations, "__defaults__", (1,))  # a cap that the query must not take
    sf = "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        assert plans.QUERIES["q47_bulk_relations"](spark, sf).select("pmid").distinct().count() > 1


def test_synthesis(spark):
    anchors = C.SCOPE_ANCHORS
    below = spark.createDataFrame([(anchors["finding"], "F1"), (anchors["substance"], "S1"), (anchors["event"], "E1")], "start string, reached string")
    triples = spark.createDataFrame([("F1", "S1", "246075003", "1", 0), ("F1", "E1", "42752001", "1", 1), ("F1", "S1", "42752001", "1", 2), ("F1", "S1", "246075003", "0", 3)], "source_id string, destination_id string, type_id string, active string, ord long")
    terms = spark.createDataFrame([("F1", "Rash (finding)"), ("S1", "Dye (substance)"), ("E1", "Fall (event)")], "id string, term string")
    got = {d.pmid: d for d in documents.synthesise(triples, terms, below, least_causative=1).collect()}
    assert got["SYNTHETIC_0000000"].text == "Rash causative-agent Dye." and got["SYNTHETIC_0000001"].text == "Rash due-to Fall." and len(got) == 2
    for d in got.values():
        assert [d.text[e.span_start : e.span_end] for e in d.entities] == [e.surface_text for e in d.entities]
    with pytest.raises(ValueError, match="fewer"):
        documents.synthesise(triples, terms, below)


def test_stamps_do_not_depend_on_row_order(spark):
    """Rows that come in another order each time they are read get their own targets."""
    rows = spark.range(4000).select(F.col("id").cast("string").alias("pmid"), F.array(F.struct(F.concat(F.lit("MESH:"), F.col("id").cast("string")).alias("original_code"), (F.col("id") % 7 == 0).alias("out_of_scope"), F.lit(None).cast("string").alias("mapped_id"), F.lit(None).cast("double").alias("mapping_confidence"), F.lit(None).cast("boolean").alias("target_active"))).alias("entities"))
    mapped = spark.range(4000).select(F.col("id").cast("string").alias("code"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("target_id"), F.lit(0.9).alias("confidence"), (F.col("id") % 2 == 0).alias("target_active"))
    got = documents.stamp_concepts(rows.hint("rebalance"), mapped).select("pmid", F.explode("entities").alias("e")).select("pmid", "e.*").collect()
    assert len(got) == 4000
    for r in got:
        i = int(r.pmid)
        assert r.mapped_id == (None if i % 7 == 0 else f"t{i}") and r.mapping_confidence == (None if i % 7 == 0 else 0.9 if i % 2 == 0 else 0.45)


def test_nearest_rows_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 6)).tolist() + [[0.0] * 6, None, [1.0] * 5]
    v[7] = v[8]
    df = spark.createDataFrame(list(enumerate(v)), "id long, vector array<double>").repartition(3)
    u = np.array([x for x in v if x and len(x) == 6 and any(x)])
    u /= np.linalg.norm(u, axis=1)[:, None]
    got = {(r["query"], r["rank"]): (r["id"], round(r["similarity"], 9)) for r in soft.nearest_rows(df.filter("id % 20 = 0"), df, 4).collect()}
    for q in range(0, 300, 20):
        s = u @ u[q]
        best = sorted((j for j in range(300) if j != q), key=lambda j: (-round(s[j], 6), j))[:4]
        assert [got[q, k + 1] for k in range(4)] == [(j, round(float(s[j]), 9)) for j in best]
    assert len(got) == 4 * 15


def test_a_hub_of_many_children_is_cut_before_the_join(spark):
    edges = spark.createDataFrame([(f"c{i:03}", "p", i) for i in range(200)] + [("p", "g", 0), ("x", "c000", 5)], "child string, parent string, ord long")
    got = hierarchy.neighbourhood(edges, spark.createDataFrame([("c150",), ("p",)], "id string"), cap=10).orderBy("start", "rank").collect()
    assert [r.id for r in got if r.start == "c150"] == ["c150", "p", "g", *(f"c{i:03}" for i in range(7))]
    assert [r.id for r in got if r.start == "p"] == ["p", "g", *(f"c{i:03}" for i in range(8))]


def test_synonym_pairs_are_drawn_once(spark):
    terms = spark.createDataFrame([("few", t) for t in "abc"] + [("many", f"t{i:03d}") for i in range(100)] + [("one", "x")], "concept_id string, term string")
    got = features.synonym_pairs(terms, 50).collect()
    pairs = Counter((r.concept_id, frozenset((r.a, r.b))) for r in got)
    assert all(len(p) == 2 and n == 1 for (_, p), n in pairs.items())
    assert Counter(c for c, _ in pairs) == {"few": 3, "many": 50}
    numbered = features.numbered_terms(terms).filter("concept_id = 'many'").collect()
    assert sorted(r["index"] for r in numbered) == list(range(100))


def test_metrics_and_labels(spark):
    assert abs(metrics.combined_metric(0.5, 0.4, 0.2) - 0.38) < 1e-12
    batch = spark.createDataFrame([(0, 0, "b"), (0, 1, "a"), (0, 2, "b"), (1, 3, "a")], "batch int, pos int, concept_id string")
    assert rows(features.batch_labels(batch), "batch", "pos", "label") == [(0, 0, 0), (0, 1, 1), (0, 2, 0), (1, 3, 0)]


def test_bulk_load_text(spark):
    df = spark.sql("SELECT 'a\\tb' s, CAST(NULL AS STRING) n, true f, array('x', NULL) l, 1.5D d, DATE'2024-01-02' day")
    got = df.select(*(X.copy_field(F.col(c), kind).alias(c) for c, kind in df.dtypes)).first()
    assert tuple(got) == ("a\\tb", "\\N", "t", '{"x",""}', "1.5", "2024-01-02")
