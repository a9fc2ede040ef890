"""Work that grows no faster than the input: rows shuffled, and results on tables of many alike keys."""

import os
import random

import duckdb
from pyspark.sql import functions as F

from lexigraft import plans
from lexigraft.functions import constants as C
from lexigraft.operators import documents, features, fulltext, hierarchy, silver, soft, windows
from lexigraft.plans import corpus_queries, load_queries
from lexigraft.plans.annotation_queries import stamped_relations

SF = "/root/testdata/sf0.001"


def shuffled(spark, df):
    """The rows of df and how many records its stages put into shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    rows = df.collect()
    return rows, total() - before


def tables(folder, **sql):
    """The smallest tables, those named replaced by the rows of a query."""
    con = duckdb.connect()
    for file in os.listdir(SF):
        name = file.split(".")[0]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{file}'")
        if name not in sql:
            os.symlink(f"{SF}/{file}", f"{folder}/{file}")
    for name, query in sql.items():
        con.sql(f"COPY ({query}) TO '{folder}/{name}.parquet'")
    return con


def checked(spark, folder, con, name):
    for file in os.listdir(folder):
        con.sql(f"CREATE OR REPLACE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    df = plans.QUERIES[name](spark, str(folder))
    rows, records = shuffled(spark, df)
    want = con.sql(plans.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in rows) == sorted(str(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())
    return records


def test_targets_of_a_nation_are_not_paired_with_all_its_codes(spark, tmp_path):
    supplier = "SELECT s_suppkey + 10 * i AS s_suppkey, s_name || CASE WHEN i % 3 = 0 THEN '' ELSE 'x' END AS s_name, CAST(i % 3 AS INTEGER) AS s_nationkey, s_acctbal FROM supplier, range(40) r(i)"
    part = "SELECT p_partkey + 1000 * i AS p_partkey, p_name, p_brand, p_type, CAST(i % 3 AS INTEGER) AS p_size, p_retailprice FROM part, range(10) r(i)"
    con = tables(tmp_path, supplier=supplier, part=part)
    assert checked(spark, tmp_path, con, "q01_tiered_best_map") < 20_000


def test_hops_are_found_once_a_cui(spark, tmp_path):
    part = "SELECT p_partkey + 997 * i AS p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part, range(60) r(i)"
    supplier = "SELECT s_suppkey + 10 * i AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier, range(40) r(i)"
    lines = "SELECT * REPLACE (l_partkey % 4 AS l_partkey, l_suppkey + 10 * (l_orderkey % 40) AS l_suppkey) FROM lineitem"
    con = tables(tmp_path, part=part, supplier=supplier, lineitem=lines)
    assert checked(spark, tmp_path, con, "q55_map_codes") < 70_000


def test_relations_are_looked_up_once(spark):
    plan = stamped_relations(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert C.relation_table(spark).count() and plan.count("element_at(_table") == 1


def test_windows_of_documents_are_cut_without_a_shuffle(spark, tmp_path, monkeypatch):
    """The same windows as those of single pieces, whatever the stride, with empty, null and unknown words' documents."""
    texts = ["ab abc  ba", None, "", " ", "zz ab", "a" * 300 + " b", " ".join(["abcab"] * 40)]
    docs = [(i, t.split(" ") if t is not None else None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc long, texts array<string>").coalesce(1)
    pieces = spark.createDataFrame([(p,) for p in ("a", "ab", "b", "##a", "##b", "##c")], "piece string")
    rows = []
    for i, words in docs:
        at = 0
        for place, word in enumerate(words or []):
            rows.append((i, place, at, word))
            at += len(word) + 1
    words = spark.createDataFrame(rows, "doc long, word long, start long, text string")
    want = sorted(map(str, windows.windows(windows.numbered(windows.word_pieces(words, pieces)), 7, 3).collect()))
    assert sorted(map(str, windows.document_words(df).collect())) == sorted(map(str, words.collect()))
    for stride in (windows.STRIDE, 3):
        monkeypatch.setattr(windows, "STRIDE", stride)
        found, records = shuffled(spark, windows.document_windows(df, pieces, 7, 3))
        assert sorted(map(str, found)) == want and records <= 12  # of the vocabulary


def test_windows_and_spans_of_the_same_id(spark, tmp_path):
    con = tables(tmp_path, documents="SELECT * REPLACE (CASE WHEN doc_id % 50 < 2 THEN doc_id - doc_id % 50 ELSE doc_id END AS doc_id) FROM documents")
    assert checked(spark, tmp_path, con, "q73_windows") + checked(spark, tmp_path, con, "q73b_batches") < 60_000


def test_files_of_a_stream_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    seen, write = [], load_queries.files.write_documents

    def written(docs, path):
        seen.append(docs.rdd.getNumPartitions())
        write(docs, path)

    monkeypatch.setattr(load_queries.files, "write_documents", written)
    con = tables(tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        checked(spark, tmp_path, con, "q74_stamped_stream")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert min(seen) > 1


def test_bulk_relations_are_made_once(spark):
    """Relations are a table of their own when documents and mentions are made, so the plan no longer reads orders."""
    plan = plans.QUERIES["q47b_bulk_documents"](spark, SF)._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert not any("o_orderkey" in plan.apply(i).toString() for i in range(plan.size()))


def test_roles_with_bars_prefixes_and_blanks(spark):
    """The part after the first bar without its prefix, as the regular expressions gave it."""
    codes = ["Chemical|MESH:D1", "MESH:D2", "Disease| MESH:D3 |x", "Disease|MESH:MESH:D4", "Gene|D5", "Chemical|", "Chemical|-", "|MESH:D6", None]
    rows = spark.createDataFrame([(str(i), "treat", c, "Disease|MESH:D9", i) for i, c in enumerate(codes)], "pmid string, relation string, subject string, object string, ord long")
    found = silver.bulk_relations(rows, spark.createDataFrame([], "pmid string"), None).collect()
    assert sorted((r.pmid, r.subject_type, r.subject) for r in found) == [("0", "Chemical", "D1"), ("2", "Disease", "D3 |x"), ("3", "Disease", "MESH:D4")]


def test_documents_are_read_once_for_their_targets(spark, tmp_path):
    """Codes of several parts: an active target first, then the surer, then the earlier part; documents stand once in the plan."""
    codes = [["MESH:D1", "D2,mesh:D3", "D3;D2", "D4|D5", "D5, D6", "-", "", "D9"], ["D1"], [], None]
    rows = [(i, None if c is None else [(x, x == "D1" and i == 1, None, None, None) for x in [*c, None]]) for i, c in enumerate(codes)]
    kind = "id int, entities array<struct<original_code: string, out_of_scope: boolean, mapped_id: string, mapping_confidence: double, target_active: boolean>>"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents")
    mapped = spark.createDataFrame([("D1", "t1", 0.9, True), ("D2", "t2", 0.9, False), ("D3", "t3", 0.5, True), ("D4", "t4", 0.6, True), ("D5", "t5", 0.6, True), ("D6", "t6", 0.8, True), ("D1", "t0", 0.7, True)], "code string, target_id string, confidence double, target_active boolean")
    out = documents.stamp_concepts(spark.read.parquet(f"{tmp_path}/documents"), mapped)
    plan = out._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sum("original_code" in plan.apply(i).toString() or "entities" in plan.apply(i).toString() for i in range(plan.size())) == 1
    got = {r.id: None if r.entities is None else [(e.mapped_id, e.mapping_confidence) for e in r.entities] for r in out.collect()}
    none = (None, None)
    assert got == {0: [("t1", 0.9), ("t3", 0.5), ("t3", 0.5), ("t4", 0.6), ("t6", 0.8), none, none, none, none], 1: [none, none], 2: [none], 3: None}


def test_mapping_files_are_as_many_as_their_rows_need(spark, monkeypatch, tmp_path):
    """No task sorts a fixed share of the rows, however many there are."""
    monkeypatch.setattr(load_queries, "folder", lambda spark, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(load_queries, "FILE_ROWS", 500, raising=False)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    found = plans.QUERIES["q60d_mapping_files"](spark, SF)
    files = [f for f in os.listdir(f"{tmp_path}/mapping") if f.endswith(".csv")]
    assert rows // 500 * 0.8 <= len(files) <= rows // 500
    want = duckdb.sql(plans.ORACLE_SQL["q60d_mapping_files"].replace("FROM lineitem", f"FROM '{SF}/lineitem.parquet'")).fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_names_are_encoded_once(spark):
    """300 codes of two names, over two targets of one name; a code and a target without a name."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encode(name):
        calls.add(1)
        return [float(len(name)), 1.0]

    codes = spark.createDataFrame([(f"c{i}", f"t{i % 2}") for i in range(300)] + [("x", "t0")], "code string, primary string")
    near = spark.createDataFrame([("t0", "t0", 0), ("t0", "t1", 2), ("t0", "t2", 2), ("t1", "t1", 0)], "primary string, target_id string, hops int")
    names = spark.createDataFrame([(f"c{i}", "ab"[i % 3 == 0] * 2) for i in range(300)] + [("t0", "tt"), ("t1", "tt")], "key string, name string")
    lin = spark.createDataFrame([("t0", "t0", 1.0), ("t0", "t1", 0.5)], "a string, b string, lin double")
    got = {(r.code, r.target_id): r.prob for r in soft.soft_map(codes, near, names, encode, lin, 1.0).collect()}
    assert calls.value == 3 and len(got) == 150 * 3 + 150 + 3
    assert got["c1", "t1"] == 1.0 and got["c0", "t0"] > got["c0", "t1"] > got["c0", "t2"] > 0
    assert abs(sum(got["c0", t] for t in ("t0", "t1", "t2")) - 1) < 1e-5
    assert got["x", "t2"] > got["c0", "t2"]  # without names the others have no lead by name


def test_pairs_are_not_multiplied_by_common_ancestors(spark, monkeypatch):
    """Nodes under a chain of 30: 900 pairs have all of it in common; tasks are as many as the pairs ask for."""
    monkeypatch.setattr(hierarchy, "ROWS", 10)
    above = [(f"n{i}", f"n{j}") for i in range(31) for j in range(i + 1, 31)] + [(f"{s}{k}", f"n{j}") for s in "ab" for k in range(30) for j in range(31)]
    ic = spark.createDataFrame([(f"n{i}", (30 - i) / 10) for i in range(31)] + [(f"{s}{k}", 5.0) for s in "ab" for k in range(30)], "id string, ic double")
    ancestors = spark.createDataFrame(above, "start string, reached string")
    pairs = spark.createDataFrame([(f"a{i}", f"b{j}") for i in range(30) for j in range(30)] + [("a1", "a1"), ("a1", "n5"), ("n29", "n2"), ("a1", "none"), ("none", "none")], "a string, b string")
    found = hierarchy.lin_similarity(pairs, ancestors, ic)
    rows, records = shuffled(spark, found)
    got = {(r.a, r.b): r.lin for r in rows}
    assert len(rows) == len(got) == 905 and records < 8_000 and found.rdd.getNumPartitions() == 91
    assert got["a3", "b7"] == 2 * 3.0 / 10 and got["a1", "n5"] == 2 * 2.5 / 7.5 and got["n29", "n2"] == 2 * 0.1 / (0.1 + 2.8)
    assert got["a1", "a1"] == got["none", "none"] == 1.0 and got["a1", "none"] == 0.0


def test_index_shuffles_texts_not_words(spark):
    """3,000 documents of 40 words, half of them copies: building moves documents and lists, searching a list for each word and block."""
    texts = [(i, " ".join(f"w{(i % 1500) * j % 97}" for j in range(1, 41))) for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc long, text string")
    asked = spark.createDataFrame([("x", "w1 w2 w3 w4 w5"), ("y", "w7"), (None, "w1")], "query string, text string")
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    total = lambda found: sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))
    before = total(stages())
    rows = fulltext.ranked(fulltext.build(docs, block=500), asked, 3).collect()
    records = total(stages()) - before
    assert sorted((r["query"], r["rank"]) for r in rows) == [(q, i) for q in "xy" for i in (1, 2, 3)]
    best = {q: [r.doc for r in sorted(rows, key=lambda r: r["rank"]) if r["query"] == q] for q in "xy"}
    assert all(d[0] + 1500 == d[1] or d == sorted(d) for d in best.values())  # copies score alike
    assert records < 12_000
    hits, _ = shuffled(spark, fulltext.phrases(fulltext.build(docs, block=500), asked.filter("query = 'x'").withColumn("text", F.lit("w1 w2 w3"))))
    assert {r.doc: r.hits for r in hits} == {d: t.split().count("w1") for d, t in texts if (d % 1500) % 97 == 1}


def test_lines_are_looked_up_from_the_numbers_asked_for(spark, tmp_path, monkeypatch):
    """The closure starts at the 40 numbers at most that lines ask for, not at all parts."""
    seeds, closure = [], hierarchy.closure
    monkeypatch.setattr(hierarchy, "closure", lambda rows, ids, **how: seeds.append(ids.count()) or closure(rows, ids, **how))
    checked(spark, tmp_path, tables(tmp_path), "q68h_dag_below")
    assert len(seeds) == 1 and seeds[0] <= 40


def unsent(spark, run):
    """run() with joins of tables that are too large to be sent."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entity_pairs_are_made_where_their_document_is(spark, tmp_path):
    """A document's lines are shuffled, its pairs aren't; what repeats or is null stays as it was."""
    con = tables(tmp_path)
    assert unsent(spark, lambda: checked(spark, tmp_path, con, "q34b_entity_pairs")) < 8_000
    entities = spark.createDataFrame([("d", i) for i in range(4)] + [("e", 0), ("e", 1), (None, 0), (None, 1)], "doc string, idx int")
    positives = spark.createDataFrame([("d", 0, 1, "a", 0.5, 1), ("d", 0, 1, "b", 0.7, 2), ("d", 0, 1, "c", 0.7, 0), ("d", 7, 8, "x", None, 0), (None, 0, 1, "n", 0.5, 0)], "doc string, i int, j int, label string, probability double, ord int")
    got = [tuple(r) for r in features.entity_pairs(entities, positives, 2.0, 5).collect()]
    assert sorted(str(g) for g in got if g[3] != "no-relation") == ["('d', 0, 1, 'c', 0.7)", "('d', 7, 8, 'x', None)", "(None, 0, 1, 'n', 0.5)"]
    rest = [g for g in got if g[3] == "no-relation"]
    assert len(rest) == len(set(rest)) == 3 and all(g[0] == "d" and g[1] != g[2] and g[1:3] != (0, 1) and g[4] == 1.0 for g in rest)


def test_soft_targets_of_a_mention_are_those_of_its_code(spark, tmp_path):
    """Mentions are shuffled, not mentions times targets; those of several rows and codes without a target are added up."""
    con = tables(tmp_path)
    assert unsent(spark, lambda: checked(spark, tmp_path, con, "q30_soft_targets")) < 30_000
    mentions = spark.createDataFrame([(1, "a", "z", 0.5), (2, "a", "t", 0.9), (2, "b", "u", 0.3), (3, "none", "m", None), (4, "none", None, None), (5, "open", "t", None), (6, "void", "q", None), (7, None, "m", 0.1)], "mention int, code string, mapped_id string, confidence double")
    rows = spark.createDataFrame([("a", "s", 1.0), ("a", "t", 2.0), ("a", "t", 1.0), ("b", "t", 4.0), ("open", None, 0.5), ("open", "t", 1.0), ("void", "s", 0.0)], "code string, target_id string, prob double")
    got = sorted(tuple(r) for r in soft.norm_targets(mentions, rows).select("mention", "target_id", "prob", "weight").collect())
    assert got == [(1, "s", 0.25, 0.5), (1, "t", 0.75, 0.5), (2, "s", 0.125, 0.9), (2, "t", 0.875, 0.9), (3, "m", 1.0, 1.0), (5, "t", 1.0, 1.0), (7, "m", 1.0, 0.1)]


def test_solver_reads_documents_once(spark):
    """Lines are shuffled once; what documents hold is only asked for if the classes are too many to be sent."""

    class Late:
        def collect(self):
            return plans.QUERIES["q45_constraint_solver"](spark, SF).collect()

    rows, records = shuffled(spark, Late())
    assert len(rows) > 1_000 and records < 2 * len(rows)


def test_layers_send_no_table_through_the_driver(spark):
    edges = spark.createDataFrame([(i, i // 2) for i in range(1, 300)] + [(i, i // 3) for i in range(1, 300)], "child long, parent long")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    assert {r.id: r.layer for r in hierarchy.layers(edges).collect()}[256] == 9
    plans_ = store.executionsList(before, 1_000)
    assert plans_.size() > 9 and not any("BroadcastExchange" in plans_.apply(i).physicalPlanDescription() for i in range(plans_.size()))


def bioc_files(spark, monkeypatch, folder, name):
    """The files that a query writes on its way, once its rows are found to be those of its SQL."""
    monkeypatch.setattr(corpus_queries.H, "shared_folder", lambda spark: str(folder))
    monkeypatch.setattr(corpus_queries, "FILE_DOCUMENTS", 100, raising=False)
    got = sorted(tuple(r) for r in plans.QUERIES[name](spark, SF).collect())
    assert got == sorted(duckdb.sql(plans.ORACLE_SQL[name].replace("FROM lineitem", f"FROM '{SF}/lineitem.parquet'")).fetchall())
    return [f"{d}/{f}" for d, _, files in os.walk(folder) for f in files if f.startswith("part-")], len(got)


def test_bioc_files_are_compressed(spark, monkeypatch, tmp_path):
    """XML is some twenty times its content; a file, which one task reads whole, holds so many documents at most."""
    files, many = bioc_files(spark, monkeypatch, tmp_path, "q72b_bioc_files")
    assert len(files) >= many / 100 and all(f.endswith(".xml.gz") for f in files)
    assert sum(os.path.getsize(f) for f in files) < 200 * many


def test_broken_bioc_files_are_compressed(spark, monkeypatch, tmp_path):
    """The silver form writes broken documents too, in files of their own."""
    files, many = bioc_files(spark, monkeypatch, tmp_path, "q72c_bioc_silver")
    assert {f.rsplit("/")[-2] for f in files} == {"whole", "broken"} and all(f.endswith(".gz") for f in files)
    assert sum(os.path.getsize(f) for f in files) < 200 * many


def test_outcomes_shuffle_codes_only(spark, tmp_path):
    """Texts, spans and relations of documents stay out of the shuffles in which entities meet their targets."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    con, before = tables(tmp_path), written()
    unsent(spark, lambda: checked(spark, tmp_path, con, "q51_mapping_outcomes"))
    assert written() - before < 200 * con.sql("SELECT count(*) FROM lineitem").fetchall()[0][0]
    docs = spark.sql("SELECT 'a' AS pmid, 'c' AS corpus, 'train' AS split, array(named_struct('original_code', 'D1', 'out_of_scope', false, 'surface_text', 'x'), named_struct('original_code', 'D2', 'out_of_scope', true, 'surface_text', 'y')) AS entities, 'text' AS text")
    docs = docs.union(docs).union(docs.selectExpr("NULL", "corpus", "split", "cast(NULL AS " + docs.schema["entities"].dataType.simpleString() + ")", "text"))
    mapped = spark.createDataFrame([("D1", "t1", 0.9, True)], "code string, target_id string, confidence double, target_active boolean")
    found = documents.mapping_outcomes(documents.stamp_concepts(documents.coded(docs), mapped)).collect()
    assert [tuple(r) for r in found] == [("c", "train", 2, 0, 0, 2)]


def test_all_spans_come_back_from_windows(spark, tmp_path, monkeypatch):
    """Short words, words longer than a window, documents without an id, and spans of any kind against all windows of their document."""
    documents_ = "SELECT * REPLACE (CASE WHEN doc_id = 3 THEN NULL ELSE doc_id END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' ' || repeat('x', 900) || ' a  of' ELSE text END AS text) FROM documents"
    con = tables(tmp_path, documents=documents_, benchmark="SELECT * REPLACE (CASE WHEN item_id = (SELECT min(item_id) FROM benchmark) THEN repeat('x', 900) || '  a' ELSE text END AS text) FROM benchmark")
    checked(spark, tmp_path, con, "q73c_spans_of_windows")

    rnd, docs, rows = random.Random(3), [0, 1, 2, None], []
    for d in docs:
        at = 0
        for _ in range(60):
            at += rnd.choice([0, 0, 1, 5])
            n = rnd.choice([1, 2, 3, 20])
            rows.append((d, at, at + n, "p"))
            at += n
    cut_ = windows.windows(windows.numbered(spark.createDataFrame(rows, "doc long, start long, end long, piece string").filter("doc is not null")), 6, 2)
    lost = cut_.filter("doc = 0").withColumn("doc", F.lit(None).cast("long"))  # a null document with the windows of the first
    found = cut_.union(lost).coalesce(3)
    spans = [(d, f"{d}-{i}", a, a + rnd.choice([0, 1, 3, 10, 40, 200])) for d in docs for i, a in enumerate(rnd.choices(range(400), k=150))]
    kept = {d: sorted((r for r in found.collect() if r.doc == d), key=lambda r: r.window) for d in docs}

    def brute(d, start, end):
        hits = [[i for i, (s, e) in enumerate(zip(w.starts, w.ends, strict=True)) if s < end and e > start] for w in kept[d]]
        held = [(w, h) for w, h in zip(kept[d], hits, strict=True) if h and w.starts[0] <= start and w.ends[-1] >= end]
        if held:
            w, h = held[0]
            return w.window, h[0], h[-1], w.starts[h[0]], w.ends[h[-1]]
        some = [(w, h) for w, h in zip(kept[d], hits, strict=True) if h]
        if some:
            (w, h), (v, g) = some[0], some[-1]
            return w.window, h[0], v.first + g[-1] - w.first, w.starts[h[0]], v.ends[g[-1]]

    want = sorted(str((d, i, *hit)) for d, i, start, end in spans if (hit := brute(d, start, end)))
    df = spark.createDataFrame(spans, "doc long, span string, start long, end long")
    for stretch in (windows.STRETCH, 11):
        monkeypatch.setattr(windows, "STRETCH", stretch)
        got = sorted(str(tuple(r)) for r in windows.located(df, found).collect())
        assert got == want and len(want) > 300
