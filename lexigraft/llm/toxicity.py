"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Words come in two readings, plain and with look-alike characters put back, and
are held against a short list of insults and against words and word beginnings
that labelled rows show to be toxic. Densities, nearness to the second person,
capitals, punctuation and obfuscation are the trees' inputs. One half of the
labelled sample finds the words, the other fits trees and calibration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import counts, mix64, runs, slices, values_of, words

#: Labelled rows that a fit uses at most, taken by a hash of doc_id.
FIT_ROWS = 40_000
#: Bytes of the word beginnings that are looked up; entries of the found list at most.
PREFIXES = (4, 5, 6, 8)
FOUND_WORDS = 4_000
#: A found word stands in so many toxic documents at least, and those are this share of its documents.
LEAST_DOCS, LEAST_SHARE = 4, 0.7
NEAR = 5
TREES, DEPTH = 25, 3

#: Insults of four languages, and words of the second person.
INSULTS = """
idiot idiots moron morons loser losers scum trash garbage pathetic worthless stupid disgusting clown clowns dumb fool
imbecile jerk creep liar pig filth vermin retard bastard bitch asshole shit fuck fucking
dummkopf arschloch scheisse scheiße abschaum trottel depp wichser hurensohn
connard connasse salope abruti imbécile ordure merde crétin débile
imbécil estúpido estúpida idiota basura mierda pendejo cabrón gilipollas escoria
""".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr sie tu toi te ton ta tes vous votre vos tú usted ustedes vosotros".split()

FEATURES = (
    "insults", "insult_share", "found", "found_share", "begun", "begun_share", "hidden", "hidden_share", "near_you", "you_share",
    "caps_share", "caps_words", "shout_share", "ask_share", "mark_share", "mixed_share", "log_words",
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_HIDING = _LETTER.copy()
_HIDING[list(b"@$!*|+")] = True
_LOOKS = np.arange(256)
_LOOKS[65:91] += 32
for _a, _b in zip(b"0134578@$!|+", b"oieastbasilt", strict=True):
    _LOOKS[_a] = _b
_LOOK_VALUES = values_of(_LOOKS)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = ~_LETTER
_MARK[[32, 9, 10, 11, 12, 13]] = False


def hash_words(items: list[str]) -> np.ndarray:
    """Sorted hashes of words, as words() makes them."""
    data = "\n".join(items).encode()
    if not data:
        return np.zeros(0, np.uint64)
    return np.unique(words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=True, between=~_LETTER)[3])


def among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(known, hashes)
    return known[np.minimum(at, len(known) - 1)] == hashes


def featurise(data: np.ndarray, offsets: np.ndarray, found: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text. found: sorted hashes of toxic words and beginnings."""
    n = len(offsets) - 1
    insults, you = hash_words(INSULTS), hash_words(SECOND_PERSON)
    rows, starts, ends, hashes, heads = words(data, offsets, lower=True, between=~_LETTER, prefixes=PREFIXES)
    borders = runs(rows, n)
    insult, toxic = among(hashes, insults), among(hashes, found)
    begun = np.zeros(len(hashes), bool)
    for size, head in zip(PREFIXES, heads, strict=True):
        begun |= among(head + np.uint64(size), found) & (ends - starts > size)
    look_rows, look_starts, look_ends, looks = words(data, offsets, lower=False, between=~_HIDING, values=_LOOK_VALUES)
    plain = words(data, offsets, lower=True, between=~_HIDING)[3]
    hidden = (looks != plain) & among(looks, insults)
    either = insult | toxic | begun
    close = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(among(hashes, you))
    np.add.at(close, np.maximum(at - NEAR, borders[rows[at]]), 1)
    np.add.at(close, np.minimum(at + NEAR + 1, borders[rows[at] + 1]), -1)
    near = (np.cumsum(close)[:-1] > 0) & either
    upper, digit = np.concatenate([[0], np.cumsum(_UPPER[data])]), np.concatenate([[0], np.cumsum(_DIGIT[data])])
    caps = (upper[ends] - upper[starts] == ends - starts) & (ends - starts > 1)
    digits = digit[ends] - digit[starts]
    mixed = (digits > 0) & (digits < ends - starts)
    size, chars = np.maximum(np.diff(borders), 1), np.maximum(np.diff(offsets), 1)
    of = {name: counts(mask, borders) for name, mask in (("insults", insult), ("found", toxic), ("begun", begun), ("near_you", near), ("caps_words", caps), ("mixed", mixed))}
    of["hidden"] = counts(hidden, runs(look_rows, n))
    columns = {k: np.minimum(of[k], 20) for k in ("insults", "found", "begun", "hidden", "near_you")}
    columns |= {f"{k[:-1] if k == 'insults' else k}_share": of[k] / size for k in ("insults", "found", "begun", "hidden", "mixed")}
    columns |= {"you_share": counts(among(hashes, you), borders) / size, "caps_share": counts(_UPPER[data], offsets) / chars, "caps_words": of["caps_words"] / size}
    columns |= {"shout_share": counts(data == 33, offsets) / chars, "ask_share": counts(data == 63, offsets) / chars, "mark_share": counts(_MARK[data], offsets) / chars}
    columns["log_words"] = np.log1p(np.diff(borders))
    return np.stack([columns[f].astype(float) for f in FEATURES], axis=1)


def with_features(docs: DataFrame, keep: list[str], found: np.ndarray) -> DataFrame:
    """The columns `keep` and a column for each feature, named _f_...; a null text counts as empty."""
    broadcast = docs.sparkSession.sparkContext.broadcast(found)  # FOUND_WORDS hashes at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in slices(batch.column(batch.num_columns - 1)):
                values = featurise(data, offsets, broadcast.value)
                kept = [batch.column(i).slice(start, end - start) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(values[:, i]) for i in range(len(FEATURES)))], names=[*keep, *(f"_f_{f}" for f in FEATURES)])

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(f"_f_{f}", T.DoubleType()) for f in FEATURES)])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("string").alias("_text")).mapInArrow(each, schema)


def toxic_words(docs: DataFrame) -> np.ndarray:
    """Hashes of words and beginnings that mark toxic documents, from docs (text, toxic)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False) == 1
            for start, end, data, offsets in slices(batch.column(1)):
                rows, starts, ends, hashes, heads = words(data, offsets, lower=True, between=~_LETTER, prefixes=PREFIXES)
                both = [(hashes, rows)] + [((h + np.uint64(s))[ends - starts > s], rows[ends - starts > s]) for s, h in zip(PREFIXES, heads, strict=True)]
                keys, owners = (np.concatenate(x) for x in zip(*both, strict=True))
                _, once = np.unique(keys + mix64(owners.astype(np.uint64)), return_index=True)
                keys, bad = keys[once], toxic[start:end][owners[once]]
                names, inverse = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.view(np.int64)), pa.array(np.bincount(inverse, bad, len(names)).astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(names)).astype(np.int64))],
                    names=["word", "toxic", "docs"],
                )

    found = docs.select("toxic", "text").mapInArrow(each, "word long, toxic long, docs long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    share = F.col("toxic") / (F.col("docs") + 1)
    found = found.filter((F.col("toxic") >= LEAST_DOCS) & (share >= LEAST_SHARE)).orderBy(F.desc(F.col("toxic") * share), "word").limit(FOUND_WORDS)
    return np.sort(np.array([r.word for r in found.select("word").collect()], np.int64).view(np.uint64))


class Model:
    """Found words, trees and calibration; score() adds the columns score and predicted."""

    def __init__(self, found: np.ndarray, trees, calibration) -> None:
        self.found, self.trees, self.calibration = found, trees, calibration

    def score(self, docs: DataFrame, keep: list[str], at: float = 0.7) -> DataFrame:
        """The columns `keep`, score (0 to 1) and predicted (1 if score >= at); every row once, empty texts and repeated rows too.

        Columns of `keep` that are called like a result, or with a leading
        underscore like the columns in between, give way; put them in a struct to
        carry them. An empty table gives no rows.
        """
        own = {"score", "predicted", "_features", "_margin", "_probability", "_label", "_raw", "_calibrated", *(f"_f_{f}" for f in FEATURES)}
        keep = [c for c in keep if c.lower() not in own]
        rows = with_features(docs, keep, self.found)
        if self.trees is None:  # one class only: nothing to tell apart
            return rows.select(*(F.col(f"`{c}`") for c in keep), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
        rows = self.calibration.transform(raw(self.trees.transform(rows)))
        # steps of the calibration keep the trees' order within
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.99 * F.col("_calibrated") + 0.01 * F.col("_raw")))
        return rows.select(*(F.col(f"`{c}`") for c in keep), score.alias("score")).withColumn("predicted", (F.col("score") >= at).cast("int"))


def raw(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_raw", vector_to_array("_probability")[1])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on labels (doc_id, toxic 0/1) of at most fit_rows documents.

    Only those rows' texts are read, and no other column of docs but doc_id.
    Labels that are null are left out; of several for one document the largest
    counts; rows that repeat a doc_id teach each. With one class only, or an
    empty table, every score is 0.
    """
    sample = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).select(F.col("doc_id").cast("long").alias("_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_id", "toxic", "text")
    half = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(4))
    found = toxic_words(rows.filter(half < 2))
    table = with_features(rows.withColumn("_half", half).filter("_half >= 2"), ["_id", "toxic", "_half"], found).coalesce(4).cache()
    try:
        fitting, calibrating = table.filter("_half = 2"), table.filter("_half = 3")
        if fitting.select("toxic").distinct().count() < 2 or calibrating.isEmpty():
            return Model(found, None, None)
        assembler = VectorAssembler(inputCols=[f"_f_{f}" for f in FEATURES], outputCol="_features")
        gbt = GBTClassifier(featuresCol="_features", labelCol="toxic", predictionCol="_label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=1)
        gbt = gbt.setRawPredictionCol("_margin").setProbabilityCol("_probability")
        trees = Pipeline(stages=[assembler, gbt]).fit(fitting)
        isotonic = IsotonicRegression(featuresCol="_raw", labelCol="toxic", predictionCol="_calibrated")
        return Model(found, trees, isotonic.fit(raw(trees.transform(calibrating)).select("_raw", F.col("toxic").cast("double").alias("toxic"))))
    finally:
        table.unpersist()
