"""Token sequences written in training order.

A keyed Feistel network permutes the numbers below a power of four; walking
along its cycle until a number is below N makes it a permutation of the N
sequences, so every sequence has its slot without a sort, a random column or a
stored permutation, and the inverse is as cheap. Each range of slots is a
partition and one file of fixed-stride records, so slot s is at a known place:
a reader goes on from any slot with one seek.

Sequences are cut from the ids of a partition's documents one after another;
only a partition's last sequence is padded. Ids are compressed wherever they wait,
in the table of ids and in the shuffle; shards hold them as they are. Files of
failed attempts are never read, since the manifest names those that count.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise
from .tokens import encoder
from .warc import place
from .words import mix64, slices, text_buffers

ROUNDS = 6
MANIFEST = "_order.json"
#: The id after each document, and that of padding, where ids are bytes; neither is a byte of UTF-8 text that counts.
END, PAD = 0xFF, 0x00
#: Ids of a sequence, bytes of a shard at least, and shards at most: larger tables have larger shards.
LENGTH, SHARD, MOST_SHARDS = 2048, 32 << 20, 1 << 16
#: Bytes of text that are tokenized together.
SLICE = 1 << 20


class Order:
    """A permutation of range(n) by a key."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        self.half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = mix64(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & ((1 << 64) - 1)))

    def _once(self, x: np.ndarray, keys: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            if back:
                left, right = right ^ (mix64(left + k) & self.mask), left
            else:
                left, right = right, left ^ (mix64(right + k) & self.mask)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        keys = self.keys[::-1] if back else self.keys
        out = self._once(np.asarray(x, np.int64).astype(np.uint64), keys, back)
        while (over := out >= np.uint64(self.n)).any():
            out[over] = self._once(out[over], keys, back)
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, False)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def encoded(texts: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, int]:
    """A table of each text's ids and the end id (ids binary, size long), packed in as few bytes an id as the vocabulary allows, and these bytes."""
    width = 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else 4
    end = end_id.to_bytes(4, "little")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column(0), SLICE):
                data = data.tobytes()
                found = tokens.encode_all([data[offsets[i] : offsets[i + 1]] for i in range(hi - lo)])
                sizes = np.array([len(p) // 4 + 1 for p in found])
                packed = np.frombuffer(b"".join([p + end for p in found]), "<u4").astype(f"<u{width}")
                borders = np.concatenate([[0], np.cumsum(sizes) * width]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(borders.tobytes()), pa.py_buffer(packed.tobytes())]), pa.array(sizes, pa.int64())], names=["ids", "size"])

    return materialise(texts.mapInArrow(each, "ids binary, size long"), "ids", compression="zstd"), width


def write(docs: DataFrame, path: str, key: int = 1, length: int = LENGTH, shard_bytes: int = SHARD, tokenizer: str | None = None, end_id: int = 1) -> dict:
    """Write the token ids of docs (text string) to `path` in the order of `key`; returns the manifest.

    Each document gives its ids and the end id; a null text counts as empty,
    rows that repeat are written each, other columns don't matter, U+0000 is a
    character like others. An empty table gives a manifest of no shards.
    Texts are tokenized once, into a table that is then read twice: to count the
    ids of each partition and to cut them. Without a tokenizer ids are UTF-8
    bytes; docs then has to be a table read from files, for it is itself read
    twice. A task fails if it finds another number of ids than were counted.
    The driver holds a number for each partition and a file name for each shard.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    width, size = 1, F.octet_length("text") + 1
    if tokenizer is not None:
        texts, width = encoded(texts, tokenizer, end_id)
        size = F.col("size")
    sizes = {r.part: r.size for r in texts.groupBy(F.spark_partition_id().alias("part")).agg(F.sum(size).alias("size")).collect()}
    texts = texts.select(texts.columns[0])
    starts, n, short = {}, 0, {}
    for part in sorted(sizes):
        starts[part] = n
        n += -(-sizes[part] // length)
        if sizes[part] % length:
            short[str(n - 1)] = sizes[part] % length
    order = Order(n, key)
    stride = length * width
    per_shard = max(1, shard_bytes // stride, -(-n // MOST_SHARDS))
    shards = max(1, -(-n // per_shard))
    run = uuid.uuid4().hex

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        sequence, rest, total = starts.get(part, 0), b"", 0

        def rows(data: bytes) -> pa.RecordBatch:
            nonlocal sequence
            count = len(data) // stride
            slots = order.slot(np.arange(sequence, sequence + count))
            sequence += count
            body = [pa.compress(data[at : at + stride], "zstd", asbytes=True) for at in range(0, len(data), stride)]
            return pa.RecordBatch.from_arrays([pa.array((slots // per_shard).astype(np.int32)), pa.array(slots), pa.array(body, pa.binary())], names=["shard", "slot", "ids"])

        for batch in batches:
            if width == 1:
                data, offsets = text_buffers(batch.column(0))
            for lo in range(0, batch.num_rows, 1024):
                hi = min(lo + 1024, batch.num_rows)
                if width == 1:
                    more = np.insert(data[offsets[lo] : offsets[hi]], offsets[lo + 1 : hi + 1] - offsets[lo], END).tobytes()
                else:
                    more = b"".join(batch.column(0).slice(lo, hi - lo).to_pylist())
                ids = rest + more
                total += len(more) // width
                whole = len(ids) // stride * stride
                rest = ids[whole:]
                if whole:
                    yield rows(ids[:whole])
        if total != sizes.get(part, 0):
            raise RuntimeError(f"partition {part} holds {total} ids, not {sizes.get(part, 0)}: docs must be read from files")
        if rest:
            yield rows(rest.ljust(stride, bytes([PAD])))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = place(path)
        out, shard, name, count = None, None, "", 0
        for batch in batches:
            for at, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if at != shard:
                    if out is not None:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "records": [count]})
                    store.create_dir(root, recursive=True)
                    shard, name, count = at, f"shard-{at:06d}-{run}-{uuid.uuid4().hex[:8]}.bin", 0
                    out = store.open_output_stream(posixpath.join(root, name), compression=None)
                out.write(pa.decompress(ids, stride, "zstd", asbytes=True))
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "records": [count]})

    dealt = texts.mapInArrow(cut, "shard int, slot long, ids binary")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
    files = sorted(dealt.mapInArrow(save, "shard long, file string, records long").collect())
    manifest = {"n": n, "key": key, "length": length, "width": width, "per_shard": per_shard, "short": short, "files": [r.file for r in files]}
    if sum(r.records for r in files) != n:
        raise RuntimeError("the shards do not hold every sequence")
    store, root = place(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(posixpath.join(root, MANIFEST), compression=None) as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def load(path: str) -> dict:
    store, root = place(path)
    with store.open_input_stream(posixpath.join(root, MANIFEST), compression=None) as source:
        return json.loads(source.read())


def records(path: str, manifest: dict, start: int, count: int) -> Iterator[bytes]:
    """The ids of `count` slots from `start`, read sequentially: how a trainer resumes."""
    store, root = place(path)
    stride, per_shard = manifest["length"] * manifest["width"], manifest["per_shard"]
    end = min(start + count, manifest["n"])
    while start < end:
        shard, at = divmod(start, per_shard)
        stop = min(end, (shard + 1) * per_shard)
        with store.open_input_file(posixpath.join(root, manifest["files"][shard])) as source:
            source.seek(at * stride)
            for _ in range(stop - start):
                yield source.read(stride)
        start = stop


def read(spark: SparkSession, path: str, chunk: int = 4096) -> DataFrame:
    """One row per slot: slot, sequence (its number in corpus order), shard, n_tokens (without padding), ids."""
    manifest = load(path)
    order = Order(manifest["n"], manifest["key"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                ids = list(records(path, manifest, first * chunk, chunk))
                slots = np.arange(first * chunk, first * chunk + len(ids))
                sequences = order.sequence(slots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array(sequences), pa.array(slots // manifest["per_shard"]), pa.array([manifest["short"].get(str(s), manifest["length"]) for s in sequences.tolist()], pa.int64()), pa.array(ids, pa.binary())],
                    names=["slot", "sequence", "shard", "n_tokens", "ids"],
                )

    chunks = -(-manifest["n"] // chunk)
    return spark.range(0, chunks, 1, max(1, min(chunks, 10_000))).mapInArrow(each, "slot long, sequence long, shard long, n_tokens long, ids binary")
