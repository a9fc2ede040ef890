"""Conversation repair, phrase collocations and language identification against SQL, brute force and held-out accuracy."""

import heapq
import itertools
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraft.llm import collocations, conversation_repair, language_id
from lexigraft.llm import queries as Q
from lexigraft.llm.quotient_filter import Filter, pack, permute, restore

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def sql_rows(name, table, path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    want = con.sql(Q.ORACLE_SQL[name])
    places = [want.columns.index(c) for c in sorted(want.columns)]
    return sorted(str(tuple(r[i] for i in places)) for r in want.fetchall())


def both(spark, name, table, df, folder):
    df.coalesce(2).write.parquet(f"{folder}/{table}.parquet")
    return rows_of(Q.QUERIES[name](spark, str(folder))), sql_rows(name, table, f"{folder}/{table}.parquet/*.parquet")


@tables
@pytest.mark.parametrize("name, table", [("op11_conversation_repair", "conversations"), ("op12_collocations", "documents")])
def test_same_as_sql(spark, name, table):
    assert rows_of(Q.QUERIES[name](spark, SF)) == sql_rows(name, table, f"{SF}/{table}.parquet")


# --- conversation repair ------------------------------------------------------


def cheapest(elements):
    """The least (cost, audit) by a search over all paths, edit by edit."""
    rows = []
    for run, initial, truncated in elements:
        rows += [(True, "", False)] * run or [(False, initial, truncated)]
    grammar = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        put = "a" if state == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, put))
        if i < len(rows):
            gone, initial, truncated = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not gone:
                if initial in grammar[state]:
                    heapq.heappush(heap, (cost + truncated, audit + "K", i + 1, grammar[state][initial]))
                heapq.heappush(heap, (cost + 2 + truncated, audit + "R", i + 1, put))
    raise AssertionError


def random_elements(rnd, n):
    return [(rnd.choice([0, 0, 0, 0, 1, 3]), rnd.choice("suaux"), rnd.random() < 0.2) for _ in range(n)]


def test_first_of_the_cheapest_edits():
    rnd = random.Random(11)
    for _ in range(600):
        elements = random_elements(rnd, rnd.randint(0, 9))
        audit, cost, _ = conversation_repair.search(elements)
        assert (cost, audit) == cheapest(elements), elements


def test_estimates_never_exceed_the_rest():
    rnd = random.Random(12)
    for _ in range(100):
        elements = random_elements(rnd, 8)
        true, guess = (f(elements, conversation_repair.DONE, True) for f in (conversation_repair.rest_costs, conversation_repair.estimates))
        assert all(g <= t for a, b in zip(guess, true, strict=True) for g, t in zip(a, b, strict=True))


def test_bounds_grow_when_the_estimate_is_too_low():
    assert conversation_repair.estimates([(0, "s", False)], conversation_repair.DONE, True)[0][0] == 0
    assert conversation_repair.search([(0, "s", False)]) == ("D", 3, conversation_repair.START)
    assert conversation_repair.search([(0, "a", False)] * 4)[:2] == cheapest([(0, "a", False)] * 4)[::-1]


def test_messy_conversations(spark, tmp_path):
    """Nulls anywhere, odd roles, blank and repeated rows, equal turns, one conversation of several pieces, extra columns."""
    rnd = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "Tool", "unknown"]
    texts = ["Well.", "so", " \t\n", None, "", "Why?\n", "a. b", "Ähm!", "é…", "Well."]
    rows = [(rnd.choice([1, 2, 3, 4, 5, None]), rnd.choice([None, *range(6)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(120)]
    rows += [(77, t // 2 if t % 97 == 0 else t, rnd.choice(roles[:5]), f"line {rnd.randint(0, 900)}{rnd.choice(['.', '', '?'])}") for t in range(1500)]
    rows += [(88, t, "user", "the same.") for t in range(700)] + [(99, 3, "user", "often")] * 300
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, cost long, audit string")
    got, want = both(spark, "op11_conversation_repair", "conversations", df, tmp_path)
    assert got == want
    pieces = conversation_repair.pieces(conversation_repair.damage(df)).groupBy("conv_id").count().filter("count > 1").collect()
    assert {r.conv_id for r in pieces} >= {77}


def test_no_conversations(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    got, want = both(spark, "op11_conversation_repair", "conversations", df, tmp_path)
    assert got == want == []


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi.", 1), (1, 1, "user", "Yes?", 2), (1, 2, "user", "no", 1)], "conv_id long, turn long, role string, text string, copies int")
    single, several = conversation_repair.repair(rows)
    found = single.collect()
    assert several.count() == 0 and len(found) == 1
    assert (found[0].audit, found[0].cost) == cheapest([(0, "a", False), (0, "u", False), (1, "", False), (0, "u", True)])[::-1]
    assert [tuple(t) for t in found[0].repaired] == [("user", ""), ("assistant", "Hi."), ("user", "Yes?"), ("assistant", "no")]


# --- collocations ---------------------------------------------------------------


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("bits", [1, 5, 17, 31, 32])
def test_filter_is_lossless(k, bits):
    rng = np.random.default_rng(k * 100 + bits)
    ids = (1 << bits) - 1 - rng.integers(0, min(1 << bits, 40), (3000, k))
    ids[:700] = ids[0]
    lanes = pack(ids, bits)
    assert np.array_equal(restore(permute(lanes, bits), bits), lanes)
    want = Counter(map(tuple, ids.tolist()))
    halves = [Filter.of(lanes[:1000], bits), Filter.of(lanes[1000:], bits)]
    for cut in (0, 1, 2):
        got = {}
        for parts in itertools.groupby(sorted((p for f in halves for p in f.split(cut)), key=lambda p: p.prefix), lambda p: p.prefix):
            whole = Filter.merged([Filter.decode(p.encode()) for p in parts[1]])
            found, counts = Filter.decode(whole.encode()).entries(k)
            got |= zip(map(tuple, found.tolist()), counts.tolist(), strict=True)
        assert got == want
    assert Filter.merged(halves).count(lanes[0]) == want[tuple(ids[0].tolist())]


def test_messy_phrases(spark, tmp_path):
    """Null langs and texts, tabs, pieces, capitals, overlaps, a very long text, repeated rows, clashing columns."""
    rnd = random.Random(3)
    base = ["New York City is big. New York City, he said", "a a a a a", "É é\tÉ é: É é", None, "", " .;\n", "x\ty  z\nx y z"]
    rows = [(i, rnd.choice(base), rnd.choice(["en", "de", None, "und"])) for i in range(2500)]
    rows.append((9999, " ".join(rnd.choice(["alpha beta gamma delta eps", "beta gamma", "Alpha", "t, u"]) for _ in range(60_000)), "en"))
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, lang string, f long, word string")
    got, want = both(spark, "op12_collocations", "documents", df, tmp_path)
    assert got == want and len(got) > 20


def test_no_phrases(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert both(spark, "op12_collocations", "documents", df, tmp_path) == ([], [])


def test_big_scores_are_exact(spark):
    a, l, r, n = 123_456_789_012, 987_654_321_987, 876_543_210_987, 1_234_567_890_123_456
    found = spark.createDataFrame([([1, 2], a)], "ids array<long>, f long")
    counts = spark.createDataFrame([([1], l), ([2], r)], "ids array<long>, f long")
    words = spark.createDataFrame([(1, "en", "x"), (2, "en", "y")], "id long, lang string, word string")
    row = collocations.ranked(found, counts, words, spark.createDataFrame([("en", n)], "lang string, n long"), 10).first()
    assert row.score == 1000 * a * n // (l * r)


@tables
def test_joined_as_sent(spark, monkeypatch):
    """Tables that are too large to be sent are joined, with the same result."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = rows_of(collocations.phrases(docs))
    monkeypatch.setattr(collocations, "SENT", 0)
    monkeypatch.setattr(collocations, "FEW", 0)
    assert rows_of(collocations.phrases(docs)) == want


def test_equal_hashes_are_told_apart():
    data = np.frombuffer(b"ab cd ab", np.uint8)
    starts, sizes = np.array([0, 3, 6]), np.array([2, 2, 2])
    assert collocations.alike(data, starts, sizes, np.array([0, 1, 0]))
    assert not collocations.alike(data, starts, sizes, np.array([0, 0, 0]))


# --- languages ------------------------------------------------------------------


def grams_of(text):
    """Words of letters with their borders, cut into n-grams of 1 to 4 without the bare border."""
    low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    out = []
    for word in low.split():
        framed = f" {word} "
        out += [framed[i : i + n] for n in range(1, language_id.ORDERS + 1) for i in range(len(framed) - n + 1) if framed[i : i + n] != " "]
    return out


def test_every_gram_is_counted_once():
    texts = ["Ab c", "", "İx-ß 12 é", "zz"]
    parts = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    found = Counter(itertools.chain.from_iterable(zip(r.tolist(), b.tolist(), strict=True) for r, b in language_id.bucketed(data, offsets)))
    alone = {}
    for t in texts:
        for g in grams_of(t):
            alone.setdefault(g, None)
    assert sum(found.values()) == sum(len(grams_of(t)) for t in texts)
    for i, t in enumerate(texts):
        assert sorted(c for (r, _), c in found.items() if r == i) == sorted(Counter(grams_of(t)).values())


def test_parts_don_t_matter(monkeypatch):
    data = np.frombuffer("Der Hund läuft; the dog runs. ".encode() * 40, np.uint8)
    offsets = np.array([0, 500, len(data)])
    total = lambda: Counter(itertools.chain.from_iterable(zip(r.tolist(), b.tolist(), strict=True) for r, b in language_id.bucketed(data, offsets)))
    whole = total()
    monkeypatch.setattr(language_id, "PART", 7)
    assert total() == whole


def test_messy_languages(spark):
    taught = [("der hund und die katze", "de"), ("the dog and the cat", "en"), (None, "en"), ("nothing", None), ("", "de"), ("le chien et le chat", "fr")]
    model = language_id.fit(spark.createDataFrame([(*t, 1.0) for t in taught], "text string, lang string, score double"))
    assert model.langs == ["de", "en", "fr"]
    asked = [(1, "the cats and dogs"), (2, "die hunde"), (3, None), (4, "12 !?"), (5, ""), (None, "le chat"), (2, "die hunde"), (6, "the dog " * 200_000)]
    found = model.predict(spark.createDataFrame([(*a, "x", 0.5) for a in asked], "doc_id long, text string, lang_pred string, score double")).collect()
    assert sorted((r.doc_id or 0, r.lang_pred) for r in found) == [(0, "fr"), (1, "en"), (2, "de"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en")]
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in found)
    none = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert [r.lang_pred for r in none.predict(spark.createDataFrame([(1, "the")], "doc_id long, text string")).collect()] == ["und"]
    assert model.predict(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_brute_force_scores(spark):
    taught = [("der hund und die katze", "de"), ("the dog and the cat", "en"), ("the mat", "en")]
    model = language_id.fit(spark.createDataFrame(taught, "text string, lang string"))
    text = "The hunde"
    sums = []
    for lang in ("de", "en"):
        counts = Counter(g for t, name in taught if name == lang for g in grams_of(t))
        total = sum(counts.values()) + language_id.PRIOR * language_id.BUCKETS
        sums.append(np.log(sum(name == lang for _, name in taught) / 3) + sum(np.log((counts[g] + language_id.PRIOR) / total) for g in grams_of(text)))
    row = model.predict(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.lang_pred == ("de", "en")[int(np.argmax(sums))]
    assert abs(row.score - 1 / (1 + np.exp(min(sums) - max(sums)))) < 1e-3


@tables
def test_held_out_languages(spark):
    found = Q.op13_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right >= 0.97 * n
