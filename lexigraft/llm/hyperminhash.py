"""MinHash near-dedup by HyperMinHash registers.

A document's set holds its distinct five-word shingles. Its hashes fall into
256 buckets; a bucket keeps its smallest value as a 16-bit register, six bits
of leading-zero count and ten bits of mantissa. Empty buckets borrow from a
full one along a fixed random walk, which keeps the chance that two documents
agree in a register at their Jaccard similarity.

Bands of five registers name candidate buckets: a pair at the threshold shares
one of the 30 bands with a chance of 0.9997. In a bucket every member is first
compared with the smallest one only, which is linear in the bucket. Buckets
whose members then still lie in several components get a second pass, where
members outside the leader's component meet all others in blocks of fixed size;
the 256 smallest hashes, the whole set for most texts, sharpen the estimate, and
one sure pair for a member and a component is enough.
Pairs whose collision-corrected estimate can't reach the threshold are dropped,
all others are confirmed on the full sets, and links give components.

Exact copies are one node from the start, so groups of copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, materialise
from .words import grams, mix64, runs, slices, words

REGISTERS, MANTISSA = 256, 10
BANDS, ROWS = 30, 5
#: Registers that the second pass carries, the smallest hashes that it carries, and members of a block.
SHORT, LOW, BLOCK = BANDS * ROWS, 256, 512
#: Broadcast a list of documents (16 bytes each) only up to this many.
BROADCAST_ROWS = 1_000_000
#: Standard deviations by which an estimate may miss.
SIGMAS = 5.0

_WALK = mix64(np.arange(REGISTERS * 4096, dtype=np.uint64) + np.uint64(77)).reshape(4096, REGISTERS) >> np.uint64(56)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    n = len(offsets) - 1
    rows, _, _, hashes = words(data, offsets, lower=True)
    borders = runs(rows, n)
    values, owners = grams(hashes, rows, size)
    cuts = runs(owners, n)
    for i in range(n):
        count = borders[i + 1] - borders[i]
        if count >= size:
            yield np.unique(values[cuts[i] : cuts[i + 1]])
        elif count:
            yield grams(hashes[borders[i] : borders[i + 1]], rows[borders[i] : borders[i + 1]], int(count))[0]
        else:
            yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The 256 registers of a sorted, non-empty set of hashes."""
    buckets = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(buckets, prepend=-1))
    low = hashes[first] & np.uint64((1 << 56) - 1)
    # leading zeros of the 56-bit value, then the ten bits after its first one
    exponent = np.frexp((low >> np.uint64(3)).astype(np.float64) + 0.5)[1]
    zeros = np.clip(53 - exponent, 0, 62).astype(np.uint64)
    shifted = (low << (zeros + np.uint64(9))) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, np.uint16)
    full = np.zeros(REGISTERS, bool)
    out[buckets[first]] = ((zeros << np.uint64(MANTISSA)) | shifted).astype(np.uint16)
    full[buckets[first]] = True
    empty = np.flatnonzero(~full)
    step = 0
    while len(empty):
        source = _WALK[step % 4096, empty] if step < 4096 else np.full(len(empty), buckets[first[0]], np.uint64)
        source = source.astype(np.int64)
        hit = full[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
        step += 1
    return out


def set_id(hashes: np.ndarray) -> int:
    """A 64-bit name of a set, the same for equal sets."""
    total = np.add.reduce(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
    return int(mix64(np.array([total + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0])


def _features(size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end, data, offsets in slices(batch.column(1)):
                counts, nodes, signatures, lows = [], [], [], []
                for found in shingle_sets(data, offsets, size):
                    counts.append(len(found))
                    nodes.append(set_id(found) if len(found) else None)
                    signatures.append(signature(found).tobytes() if len(found) else None)
                    lows.append((found[:LOW] >> np.uint64(32)).astype(np.uint32).tobytes() if len(found) else None)
                columns = [ids.slice(start, end - start), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary()), pa.array(lows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "node", "sig", "low"])

    return each


def _sets(size: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                found = [x for x in shingle_sets(data, offsets, size) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_id(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "shingles"]
                )

    return each


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band key, node) for every band of every signature."""
    for batch in batches:
        if not batch.num_rows:
            continue
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, REGISTERS)
        used = registers[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), used.shape[:2]).copy()
        for i in range(ROWS):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + used[:, :, i])
        keys = (keys & np.uint64(0xFFFFFFFFFFFFFFE0)) | np.arange(BANDS, dtype=np.uint64)  # the band's number is the key's end
        nodes = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], names=["key", "node"])


def expected_collisions(n: np.ndarray, m: np.ndarray, registers: int) -> np.ndarray:
    """Registers in which two disjoint sets of n and m elements agree by chance (Yu and Weber, 2017)."""
    return 0.169919487159739 * registers * 2.0**-MANTISSA * 4.0 * n * m / np.square(n + m)


def estimate(matches: np.ndarray, n: np.ndarray, m: np.ndarray, registers: int) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates and their standard deviations at similarity 0.75.

    Borrowed registers repeat full ones, so no more registers count as independent than the union has elements.
    """
    chance = expected_collisions(n, m, registers)
    independent = np.minimum(registers, np.maximum(n, m))
    return (matches - chance) / np.maximum(registers - chance, 1.0), np.sqrt(0.1875 * (1.0 / independent + 1.0 / registers))


def _plausible(threshold: float):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sig_a", "sig_b"))
            n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            guess, spread = estimate((a == b).sum(axis=1), n, m, REGISTERS)
            keep = (guess + SIGMAS * spread >= threshold) & (np.minimum(n, m) >= threshold * np.maximum(n, m))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return each


def _confirmed(percent: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return each


def _low_estimate(x: np.ndarray, others: np.ndarray, sizes: np.ndarray, n: float, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of x with each row of `others` (smallest hashes, padded) and their deviations.

    Two sets that are whole here are compared as they are, but for chance agreements of 32-bit hashes.
    """
    whole = (n <= LOW) & (ns <= LOW)
    last = np.where(ns > LOW, others[np.arange(len(others)), sizes - 1], np.uint32(0xFFFFFFFF))
    limit = np.minimum(last, x[-1] if n > LOW else np.uint32(0xFFFFFFFF))
    valid = (np.arange(others.shape[1]) < sizes[:, None]) & (others <= limit[:, None])
    at = np.minimum(np.searchsorted(x, others.ravel()), len(x) - 1)
    shared = ((x[at] == others.ravel()).reshape(others.shape) & valid).sum(axis=1)
    union = np.searchsorted(x, limit, "right") + valid.sum(axis=1) - shared
    return shared / np.maximum(union, 1), np.where(whole, 0.3 / np.maximum(union, 1), np.sqrt(0.1875 / np.maximum(union, 1)))


def _blocks(threshold: float):
    """Pairs of different components that may be similar, for rows sorted by group; a group has two blocks at most."""

    def asked(i: int, target: np.ndarray, band: int, c: dict) -> np.ndarray:
        """The rows of `target` that row i has to be held against."""
        n, m = c["n"][i], c["n"][target]
        target = target[(c["label"][target] != c["label"][i]) & (np.minimum(n, m) >= threshold * np.maximum(n, m)) & ~(c["open"][target] & (c["node"][target] < c["node"][i]))]
        same = c["sig"][target] == c["sig"][i]
        guess, spread = estimate(same.sum(axis=1), n, c["n"][target], SHORT)
        near = guess + SIGMAS * spread >= threshold
        near[near] = same[near].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band  # a pair counts in its first band only
        target, guess, spread = target[near], guess[near], spread[near]
        if not len(target):
            return target
        sizes = c["sizes"][target]
        low, low_spread = _low_estimate(c["low"][i, : c["sizes"][i]], c["low"][target], sizes, n, c["n"][target])
        weight = spread**2 / (spread**2 + low_spread**2)
        guess, spread = guess * (1 - weight) + low * weight, np.sqrt(weight) * low_spread
        whole = (n <= LOW) & (c["n"][target] <= LOW)
        guess, spread = np.where(whole, low, guess), np.where(whole, low_spread, spread)
        keep = guess + SIGMAS * spread >= threshold
        target, guess, spread = target[keep], guess[keep], spread[keep]
        order = np.lexsort((-(guess - SIGMAS * spread), c["label"][target]))
        target, sure = target[order], (guess - SIGMAS * spread)[order] >= threshold
        first = np.r_[True, np.diff(c["label"][target]) != 0] if len(target) else np.zeros(0, bool)
        settled = sure[np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))] if len(target) else first
        return target[first | ~settled]

    def pairs(keys: np.ndarray, c: dict) -> tuple[np.ndarray, np.ndarray]:
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        borders = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        for lo, hi in zip(np.r_[0, borders], np.r_[borders, len(keys)], strict=True):
            band = int(keys[lo, 0]) & 31
            target = lo + np.flatnonzero(~c["asks"][lo:hi])
            for i in lo + np.flatnonzero(c["asks"][lo:hi]):
                right.append(c["node"][asked(i, target, band, c)])
                left.append(np.full(len(right[-1]), c["node"][i]))
        return np.concatenate(left), np.concatenate(right)

    def columns(table: pa.Table) -> dict:
        out = {k: table.column(k).to_numpy() for k in ("node", "label", "asks", "open")}
        out["n"] = table.column("n_shingles").to_numpy().astype(float)
        out["sig"] = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, SHORT)
        lows = table.column("low").to_pylist()
        out["sizes"] = np.array([len(x) // 4 for x in lows])
        out["low"] = np.frombuffer(b"".join(x.ljust(4 * LOW, b"\xff") for x in lows), np.uint32).reshape(-1, LOW)
        return out

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            keys = np.stack([table.column(c).to_numpy() for c in ("key", "block", "asker")], axis=1)
            cut = len(keys)
            if batch is not None:
                other = np.flatnonzero(np.any(keys != keys[-1], axis=1))
                cut = int(other[-1]) + 1 if len(other) else 0
            rest = table.slice(cut)
            if cut:
                a, b = pairs(keys[:cut], columns(table.slice(0, cut)))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return each


def _with_end(batches):
    yield from batches
    yield None


def _few(df: DataFrame) -> DataFrame:
    """Broadcast a list of ids if a count shows that it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _confirm(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are similar on their full shingle sets."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    asked = materialise(nodes.join(asked, "node").select("node", "first_doc"), "asked")
    texts = docs.join(_few(asked.select(F.col("first_doc"))), F.col("doc_id").eqNullSafe(F.col("first_doc")), "left_semi")
    sets = texts.select("text").mapInArrow(_sets(size), "node long, shingles binary")
    sets = materialise(sets.join(_few(asked.select("node")), "node", "left_semi").dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_confirmed(percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    docs needs doc_id long and text string; other columns don't matter. Null,
    empty and blank texts have an empty set and stand alone. A component's id is
    its smallest doc_id that isn't null. Rows that repeat a doc_id all come back;
    each is kept if its doc_id is the component's. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    threshold = percent / 100
    features = materialise(docs.mapInArrow(_features(shingle_words), "doc_id long, n_shingles long, node long, sig binary, low binary"), "features")
    nodes = materialise(
        features.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("low").alias("low")), "nodes"
    )
    bands = nodes.select("node", "sig").mapInArrow(_bands, "key long, node long")
    shared = bands.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("members")).filter("members > 1")
    members = materialise(bands.join(shared, "key"), "members")
    pairs = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    half = lambda s: nodes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    pairs = pairs.join(half("a"), "a").join(half("b"), "b").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")
    pairs = materialise(pairs.mapInArrow(_plausible(threshold), "a long, b long"), "pairs")
    links = materialise(_confirm(docs, nodes, pairs, shingle_words, percent), "links")
    labels = materialise(components(links), "components")

    # second pass: buckets of three and more that still hold several components
    known = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"{s}_label"))
    open_ = members.filter("members > 2").join(known("node"), "node", "left").join(known("leader"), "leader", "left")
    open_ = open_.select("key", "node", "members", F.coalesce("node_label", "node").alias("label"), F.coalesce("leader_label", "leader").alias("top"))
    open_ = materialise(open_, "open")
    askers = open_.filter("label <> top").groupBy("key").agg(F.count("*").alias("askers"))
    open_ = open_.join(askers, "key").join(nodes.select("node", "n_shingles", F.expr(f"substring(sig, 1, {2 * SHORT})").alias("sig"), "low"), "node")
    open_ = open_.withColumn("open", F.col("label") != F.col("top"))
    salt = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / F.lit(BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / F.lit(BLOCK)) - 1))
    body = ["node", "label", "open", "n_shingles", "sig", "low"]
    targets = open_.select("key", salt("members").alias("block"), every("askers").alias("asker"), F.lit(False).alias("asks"), *body)
    queries = open_.filter("open").select("key", every("members").alias("block"), salt("askers").alias("asker"), F.lit(True).alias("asks"), *body)
    rows = targets.union(queries).repartition("key", "block", "asker").sortWithinPartitions("key", "block", "asker")
    more = rows.mapInArrow(_blocks(threshold), "a long, b long").distinct()
    more = materialise(more.join(pairs, ["a", "b"], "left_anti"), "more")
    if not more.isEmpty():
        links = links.union(_confirm(docs, nodes, more, shingle_words, percent))
        labels = components(links)

    named = nodes.select("node", "first_doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("first_doc").alias("component_id"))
    named = named.join(smallest, "label").select("node", "component_id")
    out = features.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.when(F.col("node").isNull(), F.lit(True)).otherwise(F.col("doc_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )
