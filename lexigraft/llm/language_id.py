"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text's letters are lower-cased one by one, whatever else it holds parts words,
and each word gives its n-grams of 1 to ORDERS letters, the word's two borders
counting as letters. N-grams are hashed into buckets. Training counts buckets for
each language over all training texts: tasks count whole texts into arrays, and
Spark sums those. The model is a matrix of log-probabilities in fixed-point
integers with CELLS cells at most, so it can be broadcast whatever the input; more
languages get fewer buckets each. Sums of integers don't depend on how texts are
batched, so scores are the same on any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise
from .words import slices

#: Letters of the longest n-gram; buckets at most, a power of two; cells of the broadcast matrix at most (4 bytes each).
ORDERS, BUCKETS, CELLS = 4, 1 << 18, 1 << 22
#: What each bucket's count is smoothed by; units of a fixed-point logarithm of one.
PRIOR, UNIT = 0.1, 1 << 16
#: Languages whose counts a task holds at a time; code points that are handled together.
HELD, PART = 32, 1 << 20
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points and where each text begins among them; bytes that aren't UTF-8 count as no letter."""
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return points, begun[offsets]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def bucketed(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and bucket of every n-gram of the texts, by parts; rows rise within each order of a part."""
    points, begins = code_points(data, offsets)
    n = len(begins) - 1
    rows = np.repeat(np.arange(n), np.diff(begins))
    spread = np.zeros(len(points) + n + 1, np.uint32)  # a border before each text and after the last
    spread[np.arange(len(points)) + rows + 1] = letters()[points]
    owner = np.zeros(len(spread), np.int64)
    owner[np.arange(len(points)) + rows + 1] = rows
    kept = spread != 0
    kept[1:] |= spread[:-1] != 0
    if len(kept):
        kept[:-1] |= spread[1:] != 0
    spread, owner = spread[kept], owner[kept]
    for lo in range(0, len(spread), PART):
        part, own = spread[lo : lo + PART + ORDERS - 1], owner[lo : lo + PART + ORDERS - 1]
        first = min(PART, len(part))
        hashed = np.zeros(len(part), np.uint32)
        inner = np.ones(len(part), bool)  # no border but at an end
        for order in range(1, ORDERS + 1):
            size = len(part) - order + 1
            if size <= 0:
                break
            last = part[order - 1 :]
            hashed = hashed[:size] * np.uint32(0x01000193) + last * np.uint32(0x85EBCA6B) + np.uint32(order)
            if order > 2:
                inner = inner[:size] & (part[order - 2 : order - 2 + size] != 0)
            use = inner[:size] & ((part[:size] != 0) | (part[1 : size + 1] != 0 if order > 1 else False))
            use = use[:first] if size > first else use
            at = np.flatnonzero(use)
            mixed = hashed[at]
            mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            mixed = (mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39)
            letter = at + (part[at] == 0)
            yield own[letter], (mixed >> np.uint32(33 - BUCKETS.bit_length())).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's rows (lang, text); bucket -1 counts the texts."""
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for name, table in held.items():
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at - 1), pa.array(table[at])], names=["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1)):
            kind, names = pd.factorize(np.array(batch.column(0).slice(lo, hi - lo).to_pylist(), object))
            for k in range(0, len(names), HELD):
                some = names[k : k + HELD]
                if len(set(held) | set(some)) > HELD:
                    yield from flush()
                for i, name in enumerate(some, k):
                    held.setdefault(name, np.zeros(BUCKETS + 1, np.int64))[0] += int((kind == i).sum())
                for rows, buckets in bucketed(data, offsets):
                    of = kind[rows]
                    for i, name in enumerate(some, k):
                        held[name][1:] += np.bincount(buckets[of == i], minlength=BUCKETS)
    yield from flush()


@dataclass
class Model:
    """Languages, sorted; log-probabilities (buckets, languages) and priors in UNITs."""

    langs: list[str]
    table: np.ndarray
    prior: np.ndarray

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum for each language, and its number of n-grams."""
        n, mask = len(offsets) - 1, len(self.table) - 1
        out, grams = np.tile(self.prior, (n, 1)), np.zeros(n, np.int64)
        step = max(1024, CELLS // len(self.langs))
        for rows, buckets in bucketed(data, offsets):
            grams += np.bincount(rows, minlength=n)
            for lo in range(0, len(rows), step):
                own = rows[lo : lo + step]
                first = np.flatnonzero(np.diff(own, prepend=-1))
                out[own[first]] += np.add.reduceat(self.table.take(buckets[lo : lo + step] & mask, axis=0), first, axis=0, dtype=np.int64)
        return out, grams

    def predict(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """The kept columns with lang_pred and score, the language's posterior probability.

        Texts that are null or hold no letter get `und` and 0, as does every text of a
        model without languages. Equal languages fall to the first in their order. Rows
        that repeat come back each; an empty table gives no rows; other columns don't matter.
        """
        model = docs.sparkSession.sparkContext.broadcast((self.langs, self.table, self.prior))

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Model(*model.value)
            for batch in batches:
                names, scores = [], []
                for lo, hi, data, offsets in slices(batch.column(batch.num_columns - 1)):
                    if not own.langs:
                        names += [UNKNOWN] * (hi - lo)
                        scores.append(np.zeros(hi - lo))
                        continue
                    sums, grams = own.sums(data, offsets)
                    best = sums.argmax(axis=1)
                    gap = (sums - sums.max(axis=1, keepdims=True)) / UNIT
                    names += [own.langs[b] if g else UNKNOWN for b, g in zip(best, grams, strict=True)]
                    scores.append(np.where(grams > 0, 1 / np.exp(np.maximum(gap, -700)).sum(axis=1), 0.0))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], names=[*keep, "lang_pred", "score"])

        rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("_text"))
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
        return rows.mapInArrow(judge, ", ".join([*kinds, "lang_pred string", "score double"]))


def fit(docs: DataFrame) -> Model:
    """Learn from all rows (text, lang) of docs; rows whose lang is null teach nothing, a null text is one without n-grams.

    More than CELLS languages can't be held and raise. No rows give a model without languages.
    """
    taught = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null")
    counts = materialise(taught.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    many = counts.filter("bucket = -1").count()
    if many > CELLS:
        raise ValueError(f"{many} languages; the model holds {CELLS} at most")
    size = BUCKETS
    while size > 1 and size * many > CELLS:
        size //= 2
    folded: Column = F.when(F.col("bucket") < 0, F.col("bucket")).otherwise(F.col("bucket").bitwiseAND(size - 1))
    found = counts.groupBy("lang", folded.alias("bucket")).agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows and one for each language
    langs = sorted(found["lang"].unique().tolist())
    if not langs:
        return Model([], np.zeros((1, 0), np.int32), np.zeros(0, np.int64))
    place = found["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy()
    bucket, n = found["bucket"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    texts, table = np.zeros(len(langs)), np.zeros((size, len(langs)))
    texts[place[bucket < 0]] = n[bucket < 0]
    table[bucket[bucket >= 0], place[bucket >= 0]] = n[bucket >= 0]
    logs = np.log((table + PRIOR) / (table.sum(axis=0) + PRIOR * size))
    return Model(langs, np.rint(logs * UNIT).astype(np.int32), np.rint(np.log(texts / texts.sum()) * UNIT).astype(np.int64))
