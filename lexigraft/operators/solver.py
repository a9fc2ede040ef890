"""Per-document constrained assignment of types, concepts and relations.

Given the types, every concept and relation is a choice of its own, so only the
types have to be searched. A batch of documents is scored as arrays, and documents of
the same pairs are solved together by variable elimination (elimination.py), whose
cost is linear for chains and trees. A document whose pairs are so many that a table
would pass elimination.CELLS is searched depth first, cutting branches whose best
possible rest can't win. Equal scores fall to the smaller candidate indices.
Documents are rows; Spark spreads them.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from . import elimination
from .elimination import IMPOSSIBLE
from .hierarchy import settled
from .lookup import attach

INPUT = (
    "pmid string, entities array<struct<types: array<struct<label: string, score: double>>, concepts: array<struct<id: string, score: double>>>>, "
    "pairs array<struct<i: int, j: int, relations: array<struct<label: string, score: double>>>>"
)
OUTPUT = "pmid string, status string, score bigint, overrides int, elapsed_ms double, entities array<struct<type: string, concept: string>>, pairs array<struct<i: int, j: int, relation: string>>"
#: Branches of one document before it falls back to each list's first candidate.
BRANCHES = 200_000
#: Concepts whose classes are sent to every task at most; more are joined to the documents.
SENT = 1 << 18


def scaled(score: float) -> int:
    return round(score * C.SCORE_SCALE)


def pick(options: list, scores: list[int], allowed: list[bool]) -> int | None:
    """The index of the best allowed option, the first of equals."""
    best = None
    for k in range(len(options)):
        if allowed[k] and (best is None or scores[k] > scores[best]):
            best = k
    return best


def solve(entities: list[dict], pairs: list[dict], under: set[tuple[str, str]], anchored: set[str], valid: set[tuple[str, str, str]], checked: set[str], branches: int = BRANCHES) -> dict | None:
    """The best assignment, or None if there is none or the search is too long.

    under: (class, concept) that fit; a class that isn't in `anchored` takes any
    concept. valid: (relation, class, class) that fit, for relations in `checked`.
    """
    types = [e["types"] or [{"label": "none", "score": 0.0}] for e in entities]
    concepts: list[list[int | None]] = []
    gains: list[list[int | None]] = []  # per entity and type: its score with its best concept; None if impossible
    for e, options in zip(entities, types, strict=True):
        own, gain = [], []
        values = [scaled(c["score"]) for c in e["concepts"] or []]
        for t in options:
            allowed = [t["label"] not in anchored or (t["label"], c["id"]) in under for c in e["concepts"] or []]
            k = pick(e["concepts"] or [], values, allowed)
            own.append(k)
            gain.append(None if values and k is None else (scaled(t["score"]) if e["types"] else 0) + (values[k] if k is not None else 0))
        concepts.append(own)
        gains.append(gain)
    pairs = [p for p in pairs if p["relations"]]
    last: dict[int, list[int]] = {}
    for n, p in enumerate(pairs):
        last.setdefault(max(p["i"], p["j"]), []).append(n)

    def relation(n: int, chosen: list[int]) -> tuple[int | None, int]:
        p = pairs[n]
        a, b = types[p["i"]][chosen[p["i"]]]["label"], types[p["j"]][chosen[p["j"]]]["label"]
        values = [scaled(r["score"]) for r in p["relations"]]
        k = pick(p["relations"], values, [r["label"] not in checked or (r["label"], a, b) in valid for r in p["relations"]])
        return k, values[k] if k is not None else 0

    most = [max((g for g in gain if g is not None), default=None) for gain in gains]
    if any(m is None for m in most):
        return None
    free = [max(scaled(r["score"]) for r in p["relations"]) for p in pairs]
    rest = [0] * (len(entities) + 1)
    for i in range(len(entities) - 1, -1, -1):
        rest[i] = rest[i + 1] + most[i] + sum(free[n] for n in last.get(i, ()))
    best: dict | None = None
    left = branches

    def go(i: int, chosen: list[int], score: int) -> bool:
        nonlocal best, left
        left -= 1
        if left < 0:
            return False
        if i == len(entities):
            if best is None or score > best["score"]:
                best = {"score": score, "types": list(chosen)}
            return True
        if best is not None and score + rest[i] <= best["score"]:
            return True
        for t in range(len(types[i])):
            if gains[i][t] is None:
                continue
            chosen.append(t)
            more, possible = gains[i][t], True
            for n in last.get(i, ()):
                k, value = relation(n, chosen)
                possible &= k is not None
                more += value
            if possible and not go(i + 1, chosen, score + more):
                return False
            chosen.pop()
        return True

    if not go(0, [], 0) or best is None:
        return None
    chosen = best["types"]
    return {
        "score": best["score"],
        "types": chosen,
        "concept_index": [concepts[i][t] for i, t in enumerate(chosen)],
        "entities": [{"type": types[i][t]["label"], "concept": None if concepts[i][t] is None else entities[i]["concepts"][concepts[i][t]]["id"]} for i, t in enumerate(chosen)],
        "pairs": [{"i": p["i"], "j": p["j"], "relation": p["relations"][relation(n, chosen)[0]]["label"]} for n, p in enumerate(pairs)],
    }


def parted(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The length of each list, 0 for a null one, and all values one after another."""
    return lists.value_lengths().fill_null(0).to_numpy().astype(np.int64), lists.flatten()


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def crossed(*lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of all combinations of as many choices as each list says for a row: the row, and each choice's number."""
    size = np.prod(lengths, axis=0)
    row = np.repeat(np.arange(len(size)), size)
    within = np.arange(int(size.sum())) - np.repeat(starts_of(size)[:-1], size)
    out = []
    for length in reversed(lengths):
        out.append(within % np.maximum(length[row], 1))
        within = within // np.maximum(length[row], 1)
    return (row, *reversed(out))


def codes_of(values: pa.Array, names: list[str]) -> tuple[np.ndarray, list[str]]:
    """Numbers of strings, those of `names` first, -1 for null; and all names."""
    found = values.dictionary_encode()
    place = {n: i for i, n in enumerate(names)}
    of = np.array([place.setdefault(n, len(place)) for n in found.dictionary.to_pylist()] + [-1], np.int64)
    return of[found.indices.fill_null(-1).to_numpy().astype(np.int64)], list(place)


def best_of(rows: np.ndarray, n: int, scores: np.ndarray, index: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n rows the best allowed score, IMPOSSIBLE if there is none, and its first index, else -1; indices rise in a row."""
    score, chosen = np.full(n, IMPOSSIBLE, np.int64), np.full(n, -1, np.int64)
    np.maximum.at(score, rows[allowed], scores[allowed])
    hit = np.flatnonzero(allowed & (scores == score[rows]))[::-1]
    chosen[rows[hit]] = index[hit]
    return score, chosen


def listed_classes(fits: pa.Array) -> dict[str, list[str]]:
    """The classes of each concept in lists of entries (key, value)."""
    found = fits.flatten()
    own = pc.struct_field(found, "key").dictionary_encode()
    first = np.unique(own.indices.to_numpy(), return_index=True)[1]
    return dict(zip(own.dictionary.to_pylist(), pc.struct_field(found, "value").take(pa.array(first)).to_pylist(), strict=True))


def solve_batch(batch: pa.RecordBatch, classes_of: dict[str, list[str]], anchored: set[str], good: set[tuple[str, str, str]], checked: set[str], branches: int) -> pa.RecordBatch:
    """The OUTPUT rows of a batch (pmid, entities, pairs); classes_of: the classes that a concept fits, by concept."""
    began = time.perf_counter()
    docs = batch.num_rows
    n_entities, entities = parted(batch.column(1))
    n_types, types = parted(pc.struct_field(entities, "types"))
    n_concepts, concepts = parted(pc.struct_field(entities, "concepts"))
    n_pairs, pairs = parted(batch.column(2))
    n_relations, relations = parted(pc.struct_field(pairs, "relations"))
    labels, names = codes_of(pc.struct_field(types, "label"), ["none"])
    ids, concept_names = codes_of(pc.struct_field(concepts, "id"), [])
    kinds, kind_names = codes_of(pc.struct_field(relations, "label"), [])
    points = lambda rows: np.rint(pc.struct_field(rows, "score").fill_null(0.0).to_numpy() * C.SCORE_SCALE).astype(np.int64)  # noqa: E731  half to even, as round() does
    type_points, concept_points, relation_points = points(types), points(concepts), points(relations)

    # what fits what, as tables over the batch's names
    under = np.zeros((len(names), len(concept_names) + 1), bool)
    under[[i for i, x in enumerate(names) if x not in anchored]] = True
    label_of, concept_of = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(concept_names)}
    for concept, place in concept_of.items():
        for c in classes_of.get(concept, ()):
            if c in label_of:
                under[label_of[c], place] = True
    right = np.zeros((len(kind_names), len(names), len(names)), bool)
    for k, kind in enumerate(kind_names):
        if kind not in checked:
            right[k] = True
    for kind, a, b in good:
        if kind in kind_names and a in label_of and b in label_of:
            right[kind_names.index(kind), label_of[a], label_of[b]] = True

    # entities without types have the type "none" at no points
    choices = np.maximum(n_types, 1)
    most = int(choices.max(initial=1))
    type_start, concept_start, relation_start = starts_of(n_types), starts_of(n_concepts), starts_of(n_relations)
    entity, t = crossed(choices)
    has = n_types[entity] > 0
    at = np.where(has, type_start[entity] + t, 0)
    label = np.where(has, labels[at] if len(labels) else 0, 0)
    table = np.full((len(n_entities) and int(n_entities.sum()), most), 0, np.int64)
    table[entity, t] = label
    row, c = crossed(n_concepts[entity])
    place = concept_start[entity[row]] + c
    score, picked = best_of(row, len(entity), concept_points[place], c, under[label[row], ids[place]])
    concept_pick = np.full(table.shape, -1, np.int64)
    concept_pick[entity, t] = picked
    single = np.full(table.shape, IMPOSSIBLE, np.int64)
    gain = np.where(n_concepts[entity] > 0, score, 0)
    single[entity, t] = np.where(gain == IMPOSSIBLE, IMPOSSIBLE, gain + np.where(has, type_points[at] if len(labels) else 0, 0))

    # pairs: the best relation for each two types
    entity_start, pair_start = starts_of(n_entities), starts_of(n_pairs)
    doc_of = np.repeat(np.arange(docs), n_pairs)
    i, j = (pc.struct_field(pairs, f).to_numpy().astype(np.int64) for f in ("i", "j"))
    left, other = entity_start[doc_of] + i, entity_start[doc_of] + j
    pair, a, b, r = crossed(choices[left], choices[other], n_relations)
    place = relation_start[pair] + r
    cell = (pair * most + a) * most + b
    score, picked = best_of(cell, len(i) * most * most, relation_points[place], r, right[kinds[place], table[left[pair], a], table[other[pair], b]])
    double, relation_pick = score.reshape(-1, most, most), picked.reshape(-1, most, most)

    # documents of the same pairs at once
    status, total, chosen = np.zeros(docs, bool), np.zeros(docs, np.int64), np.zeros(len(table), np.int64)
    groups: dict[tuple, list[int]] = {}
    told = n_relations > 0
    for d in range(docs):
        span = slice(pair_start[d], pair_start[d + 1])
        groups.setdefault((n_entities[d], tuple(zip(i[span][told[span]].tolist(), j[span][told[span]].tolist(), strict=True))), []).append(d)
    for (n, tied), group in groups.items():
        members = np.array(group)
        if not n:
            status[members] = True
            continue
        if elimination.fits(n, tied, most):
            rows = entity_start[members][:, None] + np.arange(n)
            with_relations = np.flatnonzero(told)
            begin = np.searchsorted(with_relations, pair_start[members])
            own_pairs = with_relations[begin[:, None] + np.arange(len(tied))] if tied else np.zeros((len(members), 0), np.int64)
            score, picked = elimination.solve(single[rows], tied, double[own_pairs])
            status[members], total[members] = score > IMPOSSIBLE // 2, score
            chosen[rows] = np.where((score > IMPOSSIBLE // 2)[:, None], picked, 0)
            continue
        for d in group:  # too many ties for tables
            listed = lambda x: x or []
            fits = {(t, c["id"]) for e in batch.column(1)[d].as_py() for c in listed(e["concepts"]) for t in classes_of.get(c["id"], ())}
            found = solve([{"types": listed(e["types"]), "concepts": listed(e["concepts"])} for e in batch.column(1)[d].as_py()], [{**p, "relations": listed(p["relations"])} for p in batch.column(2)[d].as_py()], fits, anchored, good, checked, branches)
            if found:
                status[d], total[d] = True, found["score"]
                chosen[entity_start[d] : entity_start[d + 1]] = found["types"]

    # what was chosen; the first of every list where nothing fits
    solved = np.repeat(status, n_entities)
    index = np.where(solved, concept_pick[np.arange(len(table)), chosen] if len(table) else 0, np.where(n_concepts > 0, 0, -1))
    picked_type = pa.array(np.array([*names, ""], object)[table[np.arange(len(table)), chosen]] if len(table) else [], pa.string())
    picked_concept = pc.struct_field(concepts, "id").take(pa.array(concept_start[:-1] + index, mask=index < 0))
    out_entities = pa.StructArray.from_arrays([picked_type, picked_concept], names=["type", "concept"])
    relation = np.where(status[doc_of], relation_pick[np.arange(len(i)), chosen[left], chosen[other]] if len(i) else 0, 0)
    kept = np.flatnonzero(told)
    picked_kind = pc.struct_field(relations, "label").take(pa.array(relation_start[kept] + np.maximum(relation[kept], 0)))
    out_pairs = pa.StructArray.from_arrays([pa.array(i[kept].astype(np.int32)), pa.array(j[kept].astype(np.int32)), picked_kind], names=["i", "j", "relation"])
    overrides = np.where(status, np.bincount(np.repeat(np.arange(docs), n_entities), index > 0, docs), 0).astype(np.int32)
    cuts = lambda lengths: pa.array(starts_of(lengths).astype(np.int32))
    ms = (time.perf_counter() - began) * 1000 / max(docs, 1)
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0), pa.array(np.where(status, "sat", "fallback")), pa.array(total, mask=~status), pa.array(overrides), pa.array(np.full(docs, ms)),
            pa.ListArray.from_arrays(cuts(n_entities), out_entities), pa.ListArray.from_arrays(cuts(np.bincount(doc_of, told, docs).astype(np.int64)), out_pairs),
        ],
        names=["pmid", "status", "score", "overrides", "elapsed_ms", "entities", "pairs"],
    )


def solve_documents(docs: DataFrame, compatible: DataFrame, valid: DataFrame, branches: int = BRANCHES) -> DataFrame:
    """Solve each row of docs (INPUT); compatible (semantic_class, concept) is cut to the candidates that docs hold if it is too large to be sent.

    valid (relation, subject_class, object_class, valid) has a row for each of the
    few relations and classes. Null arrays count as empty. A document without a
    solution, or whose search takes more than `branches` steps, falls back to each
    list's first candidate. elapsed_ms is a document's share of its batch's time.
    """
    ids = F.flatten(F.transform("entities", lambda e: F.coalesce(F.transform(e["concepts"], lambda c: c["id"]), F.array().cast("array<string>"))))
    classes = settled(compatible.groupBy(F.col("concept").alias("key")).agg(F.collect_set("semantic_class").alias("value")))
    few = classes.count() <= SENT
    if not few:  # else documents needn't be read for what they hold
        own = docs.select(F.explode(ids).alias("key")).distinct()
        classes = settled(classes.join(own, "key", "left_semi"))
        few = classes.count() <= SENT
    anchored = {r[0] for r in compatible.select("semantic_class").distinct().collect()}
    table = [(r.relation, r.subject_class, r.object_class, r.valid) for r in valid.collect()]
    good, checked = {t[:3] for t in table if t[3]}, {t[0] for t in table} | set(C.TIER1_ATTRIBUTES)

    rows = docs.select("pmid", "entities", "pairs")
    sent = docs.sparkSession.sparkContext.broadcast({r.key: r.value for r in classes.collect()} if few else None)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                known = listed_classes(batch.column(3)) if sent.value is None else sent.value
                yield solve_batch(batch, known, anchored, good, checked, branches)

    return (rows if few else attach(rows, ids, classes, "fits")).mapInArrow(each, OUTPUT)


def top_candidates(scores: DataFrame, k_types: int = C.TOP_TYPES, k_concepts: int = C.TOP_CONCEPTS) -> DataFrame:
    """Candidate lists of scored spans (pmid, idx, kind, label, score): the best k of each, concepts with a softmax over them.

    A type list ends with "none" at 0.05, which takes any concept.
    """
    best = lambda kind, k: F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("score")).alias("_s"), "label", "score")))), 1, k)
    rows = scores.groupBy("pmid", "idx").agg(best("type", k_types).alias("t"), best("concept", k_concepts).alias("c"))
    types = F.concat(F.transform("t", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))), F.array(F.struct(F.lit("none").alias("label"), F.lit(0.05).alias("score"))))
    top = F.array_max(F.transform("c", lambda x: x["score"]))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + F.exp(x["score"] - top))
    concepts = F.transform("c", lambda x: F.struct(x["label"].alias("id"), (F.exp(x["score"] - top) / total).alias("score")))
    return rows.select("pmid", "idx", types.alias("types"), concepts.alias("concepts"))
