"""Quality rules as a learned decision list.

Statistics of each text are counted in one pass. From labelled rows that pass
the base test, sequential covering grows conjunctions of thresholds by
information gain on two thirds of the rows, keeping the best few of each size,
and prunes them on the rest. The first that is precise enough becomes a rule,
one that is not is set aside for the next; the rows that a rule covers go, and
covering goes on. The rules become one ordered Spark conditional.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import WHITE, counts, grams, mix64, runs, slices, words

#: Labelled rows that a fit uses at most, taken by a hash of doc_id.
FIT_ROWS = 20_000
#: Rules and conditions of a rule at most; conjunctions of a size that are grown further.
MAX_RULES, MAX_TERMS, BEAM = 12, 4, 6
#: The share of low quality among the labelled rows that a rule covers at least, and how many these are.
PRECISION, LEAST_COVER = 0.97, 5
CUTS = 24

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_NOT_NEWLINE = np.zeros(256, bool)
_NOT_NEWLINE[10] = True

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_marks", "n_digits")

#: What rules test, each a Spark expression over the statistics.
FEATURES = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    rows, _, _, hashes = words(data, offsets, lower=False)
    borders = runs(rows, n)
    lead = (data & 0xC0) != 0x80
    solid = ~WHITE[data]
    out = {"n_words": np.diff(borders), "word_chars": counts(lead & solid, offsets), "n_symbols": counts(_SYMBOL[data], offsets)}
    line_rows, starts, ends, line_hashes = words(data, offsets, lower=False, between=_NOT_NEWLINE)
    worded = np.concatenate([[0], np.cumsum(solid)])
    worded = worded[ends] > worded[starts]
    line_rows, line_hashes = line_rows[worded], line_hashes[worded]
    own = line_hashes + mix64(line_rows.astype(np.uint64))
    first = np.zeros(len(own), bool)
    first[np.unique(own, return_index=True)[1]] = True
    cuts = runs(line_rows, n)
    out["n_dup_lines"] = counts(~first, cuts)
    values, owners = grams(hashes, rows, 3)
    own = values + mix64(owners.astype(np.uint64))
    _, inverse, often = np.unique(own, return_inverse=True, return_counts=True)
    at = np.flatnonzero(rows[: len(rows) - 2] == rows[2:])[often[inverse] > 1] if len(rows) > 2 else np.zeros(0, np.int64)
    step = np.zeros(len(rows) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + 3, -1)
    out["n_repeat_words"] = counts(np.cumsum(step)[:-1] > 0, borders)
    out |= {"n_lines": np.diff(cuts), "n_chars": counts(lead, offsets), "n_upper": counts(_UPPER[data], offsets)}
    out |= {"n_marks": counts((data == 33) | (data == 63), offsets), "n_digits": counts((data >= 48) & (data < 58), offsets)}
    return out


def with_stats(docs: DataFrame, keep: list[str], into: str) -> DataFrame:
    """The columns `keep` of docs and a struct `into` of the statistics of `text`; a null text counts as empty.

    A column of `keep` that is called as the struct gives way to it.
    """
    keep = [c for c in keep if c.lower() != into.lower()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in slices(batch.column(batch.num_columns - 1)):
                found = text_stats(data, offsets)
                stats = pa.StructArray.from_arrays([pa.array(found[s], pa.int64()) for s in STATS], names=list(STATS))
                kept = [batch.column(i).slice(start, end - start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, stats], names=[*keep, into])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(into, T.StructType([T.StructField(s, T.LongType()) for s in STATS]))])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("_text")).mapInArrow(each, schema)


@dataclass(frozen=True)
class Rule:
    """All of (feature, is at most, threshold) hold."""

    terms: tuple[tuple[str, bool, float], ...]
    precision: float

    def covers(self, values: np.ndarray) -> np.ndarray:
        names = list(FEATURES)
        mask = np.ones(len(values), bool)
        for name, below, cut in self.terms:
            column = values[:, names.index(name)]
            mask &= column <= cut if below else column > cut
        return mask

    def __str__(self) -> str:
        return " and ".join(f"{name} {'<=' if below else '>'} {cut:.6g}" for name, below, cut in self.terms)


def grow(values: np.ndarray, bad: np.ndarray) -> list[tuple[tuple[str, bool, float], ...]]:
    """Conjunctions, those of most information gain first.

    Of each size those of most gain and those of most smoothed precision, BEAM
    of each, are extended by every threshold.
    """
    names, share = list(FEATURES), np.log2(max(bad.mean(), 1e-9))
    beam: list[tuple[float, float, tuple, np.ndarray]] = [(0.0, 0.0, (), np.ones(len(values), bool))]
    found: dict[tuple, float] = {}
    for _ in range(MAX_TERMS):
        wider: list[tuple[float, float, tuple, np.ndarray]] = []
        for _, _, terms, mask in beam:
            if bad[mask].all():
                continue
            for i, name in enumerate(names):
                column = values[:, i]
                inside = column[mask]
                for cut in np.unique(np.quantile(inside, np.linspace(0, 1, CUTS + 1)[:-1], method="lower")):
                    above = inside[inside > cut]
                    middle = float((cut + above.min()) / 2) if len(above) else float(cut)
                    under = column <= cut
                    for below, side in ((True, mask & under), (False, mask & ~under)):
                        p, n = int(bad[side].sum()), int(side.sum())
                        if p and n < len(inside):
                            wider.append((p * (np.log2(p / n) - share), (p + 1) / (n + 2), (*terms, (name, below, middle)), side))
        beam, seen = [], set()
        for order in ((0, 1), (1, 0)):
            room = BEAM
            for x in sorted(wider, key=lambda x: (-x[order[0]], -x[order[1]], x[2])):  # noqa: B023
                if room and x[3].tobytes() not in seen:
                    seen.add(x[3].tobytes())
                    beam.append(x)
                    room -= 1
        found |= {x[2]: x[0] for x in beam if x[0] > 0}
    return sorted(found, key=lambda t: (-found[t], len(t), t))


def learn(values: np.ndarray, bad: np.ndarray, key: np.ndarray) -> list[Rule]:
    """Sequential covering. key: numbers that deal rows to growing (two of three) and pruning, and so fix the result."""
    rules: list[Rule] = []
    left = np.ones(len(values), bool)
    while len(rules) < MAX_RULES and bad[left].sum() >= LEAST_COVER:
        growing, pruning = left & (key % 3 != 0), left & (key % 3 == 0)
        if not bad[growing].any():
            break
        rule = next((r for terms in grow(values[growing], bad[growing]) if (r := pruned(terms, values, bad, left, pruning))), None)
        if rule is None:
            break
        rules.append(rule)
        left &= ~rule.covers(values)
    return rules


def pruned(terms: tuple, values: np.ndarray, bad: np.ndarray, left: np.ndarray, pruning: np.ndarray) -> Rule | None:
    """The beginning of a conjunction that is worth most on the pruning rows, or None if it isn't precise enough."""

    def worth(n: int) -> float:
        mask = Rule(terms[:n], 0.0).covers(values) & pruning
        return (2 * bad[mask].sum() - mask.sum()) / mask.sum() if mask.any() else -1.0

    size = max(range(1, len(terms) + 1), key=lambda n: (worth(n), -n))
    mask = Rule(terms[:size], 0.0).covers(values) & left
    precision = float(bad[mask].mean()) if mask.any() else 0.0
    return Rule(terms[:size], precision) if precision >= PRECISION and mask.sum() >= LEAST_COVER else None


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learn the rules from labels (doc_id, quality: 0 is low) of at most fit_rows documents.

    Only those rows' texts are read through Python, and only documents that pass
    the base test teach, so that the list adds to it. No labels, or none of one
    class, give no rules. A label that is null is left out; of several for one
    document the smallest counts; rows that repeat a doc_id teach each.
    """
    sample = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select(F.col("doc_id").cast("long").alias("_id"), "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "quality")
    stats = with_stats(rows, ["doc_id", "quality"], "s").filter(~base_failed("s")).select("doc_id", "quality", "s.*")
    table = stats.select("doc_id", "quality", *(F.expr(f"cast({e} as double)").alias(f) for f, e in FEATURES.items())).toPandas()
    table = table.sort_values(["doc_id", *FEATURES], kind="stable")
    values = table[list(FEATURES)].to_numpy(float)
    return learn(values, table["quality"].to_numpy() == 0, mix64(table["doc_id"].to_numpy(np.int64).view(np.uint64)))


def verdict(rules: list[Rule], stats: str) -> Column:
    """An ordered Spark conditional over a struct of statistics: the number of the first rule that holds, from 1, else null."""

    def value(name: str) -> str:
        out = FEATURES[name]
        for s in STATS:
            out = out.replace(s, f"{stats}.{s}")
        return f"cast({out} as double)"

    out = F
    for number, rule in enumerate(rules, 1):
        holds = F.expr(" and ".join(f"{value(n)} {'<=' if below else '>'} {cut!r}D" for n, below, cut in rule.terms))
        out = out.when(holds, F.lit(number))
    return out if rules else F.lit(None).cast("int")


def base_failed(stats: str) -> Column:
    """Too short, or more than half of the words in windows that repeat."""
    return F.expr(f"{stats}.n_words < 50 or 100 * {stats}.n_repeat_words > 50 * {stats}.n_words")


def judge(docs: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """The columns `keep`, a struct `_stats`, base_failed, rule (the number of the rule that rejects, else null) and kept.

    Every row comes back once, in any order; null and empty texts fail the base
    test; rows that repeat get the same verdict. Columns of `keep` that are
    called like one of the results give way to it; put them in a struct to carry them.
    """
    keep = [c for c in keep if c.lower() not in ("base_failed", "rule", "kept")]
    out = with_stats(docs, keep, "_stats").withColumns({"base_failed": base_failed("_stats"), "rule": verdict(rules, "_stats")})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
