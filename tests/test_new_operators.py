"""Elimination, lookups, tiles, pooled losses, the index, the vector store and row order on small cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraft import sources as S
from lexigraft.functions import constants as C
from lexigraft.operators import documents as D
from lexigraft.operators import elimination, fulltext, hierarchy, losses, lookup, soft, solver, warehouse, windows
from lexigraft.sources import documents, vectors, vocabulary
from lexigraft.streaming import stamped_mentions


def test_elimination_equals_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, t = int(rng.integers(1, 6)), int(rng.integers(1, 4))
        every = [(a, b) for a in range(n) for b in range(n)]
        pairs = tuple(every[i] for i in rng.choice(len(every), rng.integers(0, len(every) + 1), replace=False))
        single, double = rng.integers(0, 4, (3, n, t)), rng.integers(0, 4, (3, len(pairs), t, t))
        single[rng.random(single.shape) < 0.15] = elimination.IMPOSSIBLE
        double[rng.random(double.shape) < 0.15] = elimination.IMPOSSIBLE
        scores, chosen = elimination.solve(single, pairs, double)
        for d in range(3):
            best = None
            for x in itertools.product(range(t), repeat=n):
                score = sum(int(single[d, v, x[v]]) for v in range(n)) + sum(int(double[d, k, x[a], x[b]]) for k, (a, b) in enumerate(pairs))
                if score > elimination.IMPOSSIBLE // 2 and (best is None or score > best[0]):
                    best = score, x
            assert (best is None) == (scores[d] < elimination.IMPOSSIBLE // 2)
            assert best is None or best == (scores[d], tuple(chosen[d]))


def test_scopes_of_chains_and_stars():
    assert max(map(len, elimination.scopes(50, tuple((i, i + 1) for i in range(49))))) == 1
    assert max(map(len, elimination.scopes(50, tuple((0, i) for i in range(1, 50))))) == 1
    assert not elimination.fits(20, tuple(itertools.combinations(range(20), 2)), 3)


def first_choice(entities, pairs):
    """The first candidate of every list."""
    return {
        "entities": [{"type": e["types"][0]["label"] if e["types"] else "none", "concept": e["concepts"][0]["id"] if e["concepts"] else None} for e in entities],
        "pairs": [{"i": p["i"], "j": p["j"], "relation": p["relations"][0]["label"]} for p in pairs if p["relations"]],
    }


def random_documents(seed, n):
    rnd = random.Random(seed)
    out = []
    for d in range(n):
        entities = [
            {"types": [{"label": x, "score": rnd.choice([0.1, 0.5, 0.5])} for x in rnd.sample(["A", "B", "none"], rnd.randint(0, 3))] or None, "concepts": [{"id": x, "score": rnd.choice([0.2, 0.4])} for x in rnd.sample("pqr", rnd.randint(0, 3))]}
            for _ in range(rnd.randint(0, 4))
        ]
        pairs = [{"i": i, "j": j, "relations": [{"label": x, "score": rnd.choice([0.3, 0.6])} for x in rnd.sample(["R", "S"], rnd.randint(0, 2))]} for i in range(len(entities)) for j in range(len(entities)) if i != j and rnd.random() < 0.4]
        out.append((str(d), entities or None, pairs))
    return out


@pytest.mark.parametrize("sent", [0, 1 << 18])
def test_solver_by_arrays_equals_the_search(spark, monkeypatch, sent):
    monkeypatch.setattr(solver, "SENT", sent)
    docs = random_documents(7, 150)
    compatible = [("A", "p"), ("A", "q"), ("B", "q")]
    valid = [("R", "A", "B", True), ("R", "B", "A", False), ("R", "A", "A", False)]
    df = spark.createDataFrame(docs, solver.INPUT)
    args = spark.createDataFrame(compatible, "semantic_class string, concept string"), spark.createDataFrame(valid, "relation string, subject_class string, object_class string, valid boolean")
    got = {r.pmid: r for r in solver.solve_documents(df, *args).collect()}
    good, checked = {v[:3] for v in valid if v[3]}, {"R"} | set(C.TIER1_ATTRIBUTES)
    fallbacks = 0
    for pmid, entities, pairs in docs:
        entities = [{"types": e["types"] or [], "concepts": e["concepts"]} for e in entities or []]
        want = solver.solve(entities, pairs, set(compatible), {"A", "B"}, good, checked)
        row, chosen = got[pmid], want or first_choice(entities, pairs)
        fallbacks += want is None
        assert row.status == ("sat" if want else "fallback") and row.score == (want["score"] if want else None)
        assert [e.asDict() for e in row.entities] == chosen["entities"] and [p.asDict() for p in row.pairs] == chosen["pairs"]
        assert row.overrides == (sum(bool(k) for k in want["concept_index"]) if want else 0)
    assert 5 < fallbacks < 145


def test_solver_of_wide_documents(spark):
    entities = [{"types": [{"label": "A", "score": 0.1 * (i % 3)}, {"label": "B", "score": 0.15}], "concepts": []} for i in range(16)]
    pairs = [{"i": i, "j": j, "relations": [{"label": "S", "score": 0.5}]} for i, j in itertools.combinations(range(16), 2)]
    none = spark.createDataFrame([], "semantic_class string, concept string"), spark.createDataFrame([], "relation string, subject_class string, object_class string, valid boolean")
    row = solver.solve_documents(spark.createDataFrame([("w", entities, pairs)], solver.INPUT), *none).first()
    assert not elimination.fits(16, tuple(itertools.combinations(range(16), 2)), 2)
    assert row.status == "sat" and [e.type for e in row.entities] == ["A" if i % 3 == 2 else "B" for i in range(16)]


def test_attach(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["a", "b", "a"]), (2, []), (3, None), (4, ["z", None])], "id int, keys array<string>")
    table = spark.createDataFrame([("a", 10), ("b", 20)], "key string, value int")
    got = sorted((r.id, sorted(tuple(e) for e in r.found)) for r in lookup.attach(docs, F.col("keys"), table, "found").collect())
    assert got == [(1, [("a", 10), ("b", 20)]), (1, [("a", 10), ("b", 20)]), (2, []), (3, []), (4, [])]


def test_documents_without_codes_are_spread(spark):
    """Nine of ten documents have no code; none of the tasks gets more than its share of them."""
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 10 == 0, F.array(F.col("id").cast("string"))).otherwise(F.array().cast("array<string>")).alias("keys"))
    table = spark.range(4000).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("value"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in lookup.attach(rows, F.col("keys"), table, "found").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and max(sizes) < 1500


def test_nearest_rows(spark):
    odd = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [2.0, 0.0])]
    rows = spark.createDataFrame(odd, "id long, vector array<double>")
    got = {}
    for r in soft.nearest_rows(rows, rows, 2).collect():
        got.setdefault(r.query, []).append((r["rank"], r.id, round(r.similarity, 6)))
    assert {q: sorted(x) for q, x in got.items()} == {
        1: [(1, 8, 1.0), (2, 3, 0.707107)], 2: [(1, 3, 0.707107), (2, 1, 0.0)], 3: [(1, 1, 0.707107), (2, 2, 0.707107)], 8: [(1, 1, 1.0), (2, 3, 0.707107)],
    }
    assert soft.nearest_rows(rows.limit(0), rows, 2).count() == 0 and soft.nearest_rows(rows, rows.limit(0), 2).count() == 0


def test_nearest_rows_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(soft, "BLOCK", 40)
    rng = np.random.default_rng(3)
    matrix = rng.normal(size=(300, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "id long, vector array<double>").repartition(3)
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    near = unit @ unit.T
    np.fill_diagonal(near, -9)
    for r in soft.nearest_rows(rows.filter("id < 100"), rows, 3).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("x")).collect():
        assert [x.id for x in r.x] == np.argsort(-near[r.query])[:3].tolist()


def test_vector_store(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.createDataFrame([(i, [float(i), -0.5, 1e-300]) for i in range(1000)], "id long, vector array<double>").repartition(3)
    vectors.write_vectors(rows, path)
    assert sorted((r.id, r.vector) for r in vectors.read_vectors(spark, path).collect()) == [(i, [float(i), -0.5, 1e-300]) for i in range(1000)]
    vectors.write_vectors(rows.limit(10), path, "append")
    assert vectors.read_vectors(spark, path).count() == 1010
    vectors.write_vectors(rows.limit(0), path)
    assert vectors.read_vectors(spark, path).count() == 0
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [None])], [(1, None)]):
        with pytest.raises(Exception, match="several lengths|may not be null"):
            vectors.write_vectors(spark.createDataFrame(bad, "id long, vector array<double>").coalesce(1), path)
    assert vectors.read_vectors(spark, path).count() == 0


def test_pooled_spans(spark):
    tokens = spark.createDataFrame([("d", i, [float(i), 1.0]) for i in range(20)] + [("e", 0, [5.0, 5.0]), ("e", 1, None)], "doc string, pos int, vector array<double>")
    spans = spark.createDataFrame([("d", 0, 2, 5), ("d", 1, 4, 4), ("d", 2, 0, 20), ("d", 3, 30, 31), ("e", 0, 0, 2), ("x", 0, 0, 1)], "doc string, span int, start int, end int")
    for block in (3, 4096):
        got = {(r.doc, r.span): r.vector for r in losses.pool_spans(tokens, spans, block).collect()}
        assert got == {("d", 0): [3.0, 1.0], ("d", 1): [4.0, 1.0], ("d", 2): [9.5, 1.0], ("e", 0): [5.0, 5.0]}


def test_cross_entropy(spark):
    logits = spark.createDataFrame([("d", s, x, v) for s in range(3) for x, v in (("a", 2.0), ("b", 1.0), ("c", -1.0))], "doc string, span int, label string, logit double")
    targets = spark.createDataFrame([("d", 0, "a", 1.0), ("d", 1, "b", 1.0), ("d", 1, "a", 1.0), ("d", 1, "q", 9.0), ("d", 2, "q", 1.0)], "doc string, span int, label string, prob double")
    weights = spark.createDataFrame([("d", 1, 0.5)], "doc string, span int, weight double")
    got = {r.span: r for r in losses.cross_entropy(logits, targets, weights).collect()}
    lse = np.log(np.exp([2.0, 1.0, -1.0]).sum())
    assert set(got) == {0, 1} and abs(got[0].loss - (lse - 2)) < 1e-12 and abs(got[1].loss - (lse - 1.5)) < 1e-12
    assert (got[0].weight, got[1].weight) == (1.0, 0.5) and got[0].right and got[1].right
    row = losses.mean_loss(losses.cross_entropy(logits, targets, weights)).first()
    assert row.spans == 2 and abs(row.loss - (lse - 2 + 0.5 * (lse - 1.5)) / 2) < 1e-12 and row.accuracy == 1.0


def test_full_text(spark, tmp_path):
    texts = {1: "The cat sat on the cat mat", 2: "cat", 3: None, 4: "", 5: "the the the cat! Sat: on", 6: "dog, Élan"}
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    index = fulltext.build(docs, str(tmp_path / "i"), block=2)
    asked = spark.createDataFrame([("p", "cat sat on"), ("q", "the the"), ("r", "unicorn cat"), ("s", " .,"), ("t", None), ("u", "élan"), ("v", "Élan")], "query string, text string")
    assert sorted(map(tuple, fulltext.phrases(index, asked).collect())) == [("p", 1, 1), ("p", 5, 1), ("q", 5, 2), ("v", 6, 1)]
    import math
    import re

    words = {d: [w.lower() for w in re.findall(r"\w+", t or "")] for d, t in texts.items()}
    mean = sum(map(len, words.values())) / len(words)

    def score(query, doc):
        total = 0
        for term in set(query.split()):
            df, tf = sum(term in w for w in words.values()), words[doc].count(term)
            total += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[doc]) / mean))
        return total

    for query in ("the cat", "cat on mat dog"):
        want = sorted(((-round(score(query, d), 6), d) for d in texts if score(query, d) > 0))
        for k in (1, 2, 10):
            got = sorted((r["rank"], r.doc, round(r.score, 6)) for r in fulltext.ranked(index, spark.createDataFrame([("x", query)], "query string, text string"), k).collect())
            assert [(d, s) for _, d, s in got] == [(d, -s) for s, d in want[:k]]


def test_order_over_unequal_files(spark, tmp_path):
    """The larger file is read first by Spark; the order of the paths counts all the same."""
    head = "mesh_id,snomed_id,confidence,snomed_active\n"
    (tmp_path / "part-0.csv").write_text(head + "D1,first,0.5,true\n")
    (tmp_path / "part-1.csv").write_text(head + "".join(f"X{i},t,0.5,true\n" for i in range(500)) + "D1,second,0.5,true\n")
    (tmp_path / "part-2.csv").write_text(head + "D2,x,0.5,true\n")
    assert documents.read_mapping(spark, str(tmp_path)).filter("code = 'D1'").first().target_id == "second"
    for name, n in (("a", 1), ("b", 900), ("c", 30)):
        (tmp_path / f"{name}.RRF").write_text("".join(f"{name}{i}|T|S|sty|x|y|\n" for i in range(n)))
    got = [r.cui for r in S.read_rrf(spark, str(tmp_path / "*.RRF"), "MRSTY").orderBy("ord").collect()]
    assert got == ["a0", *(f"b{i}" for i in range(900)), *(f"c{i}" for i in range(30))]


def test_deep_chains_are_whole(spark):
    edges = spark.range(20).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"), F.lit(0).cast("long").alias("ord"))
    seed = spark.createDataFrame([(20,)], "id long")
    assert sorted(r.reached for r in hierarchy.closure(edges, seed).collect()) == list(range(20))
    with pytest.raises(ValueError, match="more than 3 hops"):
        hierarchy.closure(edges, seed, max_hops=3)
    assert {r.id: r.layer for r in hierarchy.layers(edges).collect()} == {i: i for i in range(21)}


def test_layers_of_diamonds_and_cycles(spark):
    pairs = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("e", "a"), ("x", "y"), ("y", "x"), ("z", "x"), ("z", "a")]
    edges = spark.createDataFrame([(*p, 0) for p in pairs], "child string, parent string, ord long")
    assert {r.id: r.layer for r in hierarchy.layers(edges).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert {r.id for r in hierarchy.cycle_nodes(edges).collect()} == {"x", "y"}


def test_numbers_of_triples_read_from_files(spark):
    rows = [("S1", "D1", "42752001", "1", ("f", 0, 3)), ("S1", "D2", "42752001", "1", ("a", 0, 9)), ("S1", "D3", "42752001", "1", ("a", 0, 2_000_000))]
    triples = spark.createDataFrame(rows, "source_id string, destination_id string, type_id string, active string, ord struct<file: string, block: long, row: long>")
    finding = C.SCOPE_ANCHORS["finding"]
    below = spark.createDataFrame([(finding, x) for x in ("S1", "D1", "D2", "D3")], "start string, reached string")
    terms = spark.createDataFrame([(x, x) for x in ("S1", "D1", "D2", "D3")], "id string, term string")
    got = {r.pmid: r.text for r in D.synthesise(triples, terms, below, 0).collect()}
    assert {k[-1]: v.split()[-1] for k, v in got.items()} == {"0": "D2.", "1": "D3.", "2": "D1."}


def test_database_reads(spark, tmp_path):
    """A table of the database in Spark's jars, written and read in ranges of its key."""
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(100)], "id int, name string")
    rows.write.format("jdbc").options(url=url, dbtable="names", **options).save()
    ranged = vocabulary.read_jdbc(spark, url, "names", "id", 4, **options)
    assert ranged.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, ranged.collect())) == [(i, f"n{i}") for i in range(100)]
    assert vocabulary.read_jdbc(spark, url, "(SELECT * FROM names WHERE \"id\" < 0) t", "id", **options).count() == 0
    assert warehouse.load(ranged, NAMES, f"{tmp_path}/names") == 100


NAMES = warehouse.Table("id int, name string", ("id",), ("name",), {"name": tuple(f"n{i}" for i in range(100))})


def test_keyed_loads(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *data: spark.createDataFrame(list(data), "id int, name string, turn int")
    assert warehouse.read(spark, NAMES, path).count() == 0
    assert warehouse.load(rows((1, "n1", 1), (1, "n2", 0), (None, "n3", 0), (None, "n3", 0)), NAMES, path, order="turn") == 3
    assert sorted(map(str, map(tuple, warehouse.read(spark, NAMES, path).collect()))) == ["(1, 'n2')", "(None, 'n3')", "(None, 'n3')"]
    assert warehouse.load(rows((1, "n9", 0), (2, "n2", 0)), NAMES, path) == 1
    assert warehouse.load(rows((1, "n5", 0), (1, "n6", 5)), NAMES, path, replace=True, order="turn") == 0
    assert sorted(tuple(r) for r in warehouse.read(spark, NAMES, path).filter("id is not null").collect()) == [(1, "n6"), (2, "n2")]
    with pytest.raises(ValueError, match="name is null: 1 rows"):
        warehouse.load(rows((5, None, 0)), NAMES, path)
    with pytest.raises(ValueError, match="not in"):
        warehouse.load(rows((5, "other", 0)), NAMES, path)
    assert warehouse.load(rows(), NAMES, path) == 0
    warehouse.reset(spark, NAMES, path)
    assert warehouse.read(spark, NAMES, path).count() == 0
    assert warehouse.load(rows((7, "n7", 0)), NAMES, path) == 1 and warehouse.read(spark, NAMES, path).count() == 1


def test_layouts(spark):
    assert len(warehouse.TABLES) == 21
    for table in warehouse.TABLES.values():
        empty = spark.createDataFrame([], table.columns)
        assert {*table.key, *table.required, *table.allowed} <= set(empty.columns) == set(table.names)


def test_word_pieces(spark):
    """The longest piece first at every place, against a search over all prefixes."""
    rnd = random.Random(2)
    vocabulary = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 4))) for _ in range(6)} | {"##" + "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) for _ in range(7)})
    words = ["".join(rnd.choice("abc" if rnd.random() < 0.1 else "ab") for _ in range(rnd.randint(0, 9))) for _ in range(80)] + ["a" * 500]

    def greedy(word):
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                if ("##" if at else "") + word[at:end] in vocabulary:
                    break
            else:
                return [(windows.UNKNOWN, 0, len(word))]
            out.append((("##" if at else "") + word[at:end], at, end))
            at = end
        return out

    rows = spark.createDataFrame([(i % 3, i, 1000 * i, w) for i, w in enumerate(words)], "doc int, word int, start int, text string")
    got = {}
    for r in windows.word_pieces(rows, spark.createDataFrame([(p,) for p in vocabulary], "piece string")).orderBy("word", "start").collect():
        got.setdefault(r.word, []).append((r.piece, r.start - 1000 * r.word, r.end - 1000 * r.word))
    assert got == {i: greedy(w) for i, w in enumerate(words) if w}


def test_windows_cover_documents(spark):
    rows = spark.createDataFrame([(d, i, i + 1, f"p{i}") for d, n in enumerate((1, 5, 6, 10, 23)) for i in range(n)], "doc int, start long, end long, piece string")
    found = windows.windows(windows.numbered(rows, 4), 5, 2).orderBy("doc", "window").collect()
    for d, n in enumerate((1, 5, 6, 10, 23)):
        own = [list(r.starts) for r in found if r.doc == d]
        assert own == [list(range(lo, min(lo + 5, n))) for lo in range(0, max(n - 2, 1), 3)]


def test_mentions_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"t": "2024-01-01T00:00:01", "doc": 1, "pos": 0, "code": "D1"}\n' * 2 + '{"t": "2024-01-01T00:00:02", "doc": 1, "pos": 1, "code": "D9"}\n')
    mapped = spark.createDataFrame([("D1", "100")], "code string, target_id string")
    stream = spark.readStream.schema("t timestamp, doc long, pos long, code string").json(str(tmp_path / "in"))
    q = stamped_mentions(stream, mapped, "t", "1 minute").writeStream.format("memory").queryName("stamped").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.pos, r.target_id) for r in spark.sql("SELECT * FROM stamped").collect()) == [(0, "100"), (1, None)]


def test_lookups_of_a_hierarchy(spark):
    edges = spark.createDataFrame([("a", "t", 0), ("a", "u", 1), ("t", "root", 2), ("u", "root", 3)], "child string, parent string, ord long")
    above = hierarchy.closure(edges, spark.createDataFrame([("a",), ("t",)], "id string"))
    pairs = spark.createDataFrame([("a", "root"), ("a", "a"), ("t", "u"), ("x", "root"), (None, "root")], "id string, of string")
    assert sorted((str(r.id), r.below) for r in hierarchy.is_descendant(pairs, above).collect()) == [("None", False), ("a", False), ("a", True), ("t", False), ("x", False)]
    found = hierarchy.describe(spark.createDataFrame([("a",), ("x",), ("root",)], "id string"), hierarchy.depths(edges, "root"), hierarchy.memberships(edges, "root"))
    assert {r.id: (r.depth, r.tops) for r in found.collect()} == {"a": (2, ["t", "u"]), "x": (None, []), "root": (0, [])}


def test_cached_tables(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a\n")
    built = []

    def build():
        built.append(1)
        return {"x": spark.range(len(built)), "y": spark.range(7)}

    ask = lambda: documents.cached_tables(spark, str(tmp_path / "c"), [str(tmp_path / "in.txt")], build, ("x", "y"))
    assert [ask()["x"].count() for _ in range(2)] == [1, 1] and ask()["y"].count() == 7
    (tmp_path / "in.txt").write_text("bb\n")
    assert ask()["x"].count() == 2 and len(built) == 2


def test_cut_off_cache_is_built_anew(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a\n")

    def broken():
        raise RuntimeError("stopped")

    ask = lambda build: documents.cached_tables(spark, str(tmp_path / "c"), [str(tmp_path / "in.txt")], build, ("x",))
    with pytest.raises(RuntimeError, match="stopped"):
        ask(broken)
    assert ask(lambda: {"x": spark.range(3)})["x"].count() == 3
