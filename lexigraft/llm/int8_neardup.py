"""Embedding near-dedup by int8 tile products with error bounds.

Equal vectors are one node from the start. Nodes are dealt into blocks of fixed
size, and each pair of blocks is a tile: a product of int8 codes, exact in
float32 matrix arithmetic. A vector's code differs from it by a known length,
so the true cosine lies within |a||e_b| + |e_a||b| + |e_a||e_b| of the product;
only pairs that can reach the threshold are computed again in double precision.
A tile gives each node's links and a spanning star of its components, never all
pairs. The work is quadratic in the distinct vectors; memory is a tile's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import components, materialise

#: Nodes of a block, rows of a product that are made at once, dimensions of an exact float32 sum.
BLOCK, ROWS, EXACT_DIMS = 4096, 1024, 1024


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, the decoded lengths and the lengths of the errors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None])
    decoded = codes * scale[:, None]
    return codes.astype(np.int8), scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(unit - decoded, axis=1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows."""
    out = np.zeros((len(a), len(b)))
    for lo in range(0, a.shape[1], EXACT_DIMS):  # 127 * 127 * 1024 is under 2**24
        out += a[:, lo : lo + EXACT_DIMS].astype(np.float32) @ b[:, lo : lo + EXACT_DIMS].astype(np.float32).T
    return out


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of vectors of a and b with a cosine of at least the threshold; i < j if both are the same block.

    Vectors are first scaled by powers of two, so that no square overflows or vanishes.
    """
    scaled_a, scaled_b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    na, nb = np.linalg.norm(scaled_a, axis=1), np.linalg.norm(scaled_b, axis=1)
    ca, sa, la, ea = quantise(scaled_a / na[:, None])
    cb, sb, lb, eb = quantise(scaled_b / nb[:, None])
    left, right = [], []
    for lo in range(0, len(a), ROWS):
        hi = min(lo + ROWS, len(a))
        bound = product(ca[lo:hi], cb) * sa[lo:hi, None] * sb + la[lo:hi, None] * eb + ea[lo:hi, None] * lb + ea[lo:hi, None] * eb
        i, j = np.nonzero(bound >= threshold - 1e-9)
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 18):
            x, y = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
            linked = np.einsum("ij,ij->i", scaled_a[x], scaled_b[y]) / (na[x] * nb[y]) >= threshold
            left.append(x[linked])
            right.append(y[linked])
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each node's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _tiles(threshold: float, kind: str):
    def tile(rows: pa.Table) -> pa.RecordBatch:
        nodes, copies, side = (rows.column(c).to_numpy() for c in ("node", "copies", "side"))
        vectors = np.frombuffer(b"".join(rows.column("packed").to_pylist()), kind).reshape(len(nodes), -1).astype(np.float64)
        same = rows.column("left")[0].as_py() == rows.column("right")[0].as_py()
        a, b = (np.flatnonzero(side == 0),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        i, j = tile_links(vectors[a], vectors[b], same, threshold) if len(a) and len(b) else (np.zeros(0, int), np.zeros(0, int))
        i, j = a[i], b[j]
        links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
        # the star's centre is named by node, so that a component's label does not depend on row order
        star = nodes[stars(i, j, len(nodes))]
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(star[some]), pa.array(links[some].astype(np.int64))], names=["node", "centre", "links"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            keys = np.stack([rest.column(c).to_numpy() for c in ("dims", "left", "right")], axis=1)
            cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for lo, hi in zip(np.r_[0, cuts], cuts, strict=False):
                yield tile(rest.slice(lo, hi - lo))
            if len(cuts):
                rest = rest.slice(int(cuts[-1])).combine_chunks()
        if rest is not None and rest.num_rows:
            yield tile(rest)

    return each


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id, kept.

    vectors needs vec_id long and embedding array<float> or array<double>; other
    columns don't matter. Null and zero vectors and such with null or
    non-finite components link with nothing; vectors of different dimensions
    don't either. Repeated rows are links of each other. A component's id is its
    smallest vec_id that isn't null. An empty table gives no rows.
    """
    double = isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType)
    kind, size = ("<f8", 8) if double else ("<f4", 4)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for value in batch.column(1):
                values = value.values
                row = None
                if values is not None and len(values) and not values.null_count:
                    found = values.to_numpy(zero_copy_only=False).astype(kind)
                    wide = found.astype(np.float64)
                    top = np.abs(wide).max()
                    if 0 < top < np.inf:
                        row = found.tobytes()
                packed.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["vec_id", "packed"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(clean, "vec_id long, packed binary")
    rows = materialise(rows.withColumn("node", F.when(F.col("packed").isNotNull(), F.xxhash64("packed"))), "vectors")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("packed").alias("packed"), F.max("packed").alias("last"))
    # a number stands for its vector; two vectors that share one stop the job instead of being taken for copies
    clash = F.when(F.col("packed") != F.col("last"), F.raise_error(F.lit("two vectors share a hash"))).cast("boolean")
    nodes = nodes.filter(clash.isNull()).drop("last")
    nodes = materialise(nodes.withColumn("dims", F.length("packed") / size), "nodes")
    count = nodes.count()
    blocks = max(1, -(-count // block))
    dealt = nodes.select("node", "copies", "packed", F.col("dims").cast("long").alias("dims"), F.pmod(F.xxhash64("node", F.lit(3)), F.lit(blocks)).alias("own"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "dims", F.least("own", "other").cast("long").alias("left"), F.greatest("own", "other").cast("long").alias("right"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "copies", "packed"
    )
    tiles = min(blocks * (blocks + 1) // 2, 20_000)
    found = other.repartition(tiles, "left", "right").sortWithinPartitions("dims", "left", "right").mapInArrow(_tiles(threshold, kind), "node long, centre long, links long")
    found = materialise(found, "links")
    labels = components(found.filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")))
    named = nodes.select("node", "first", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    named = named.join(named.groupBy("label").agg(F.min("first").alias("component_id")), "label")
    named = named.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(alone | (F.col("vec_id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )
