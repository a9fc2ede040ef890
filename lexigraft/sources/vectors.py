"""A vector store: files of fixed-stride records, as a PySpark data source with a manifest.

A record is an 8-byte id and the vector's 64-bit floats, all little-endian, so a
vector's place is its number times the stride and any stretch of a file is a read
partition. Each task writes one file; the commit writes the manifest, which names the
dimension and the files with their numbers of records, so what failed attempts left
is never read. Overwriting puts another manifest in the old one's place.

Register with spark.dataSource.register(VectorSource); the format is "vectorfiles",
its path one that all executors reach.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFEST = "_vectors.json"
SCHEMA = "id long, vector array<double>"
#: Bytes of a read partition and of a batch.
STRETCH, BATCH = 16 << 20, 4 << 20


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def manifest(store: fs.FileSystem, root: str) -> dict:
    if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return {"dimension": 0, "files": []}
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int
    dimension: int


class VectorWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, root = place(self.path)
        store.create_dir(root, recursive=True)
        name, records, dimension, out = f"part-{uuid.uuid4().hex}.vec", 0, 0, None
        try:
            for batch in batches:
                vectors = batch.column(batch.schema.get_field_index("vector"))
                ids = batch.column(batch.schema.get_field_index("id"))
                if not batch.num_rows:
                    continue
                if vectors.null_count or ids.null_count or vectors.flatten().null_count:
                    raise ValueError("ids, vectors and their components may not be null")
                lengths = np.unique(vectors.value_lengths().to_numpy())
                if len(lengths) > 1 or dimension not in (0, lengths[0]):
                    raise ValueError("vectors of several lengths")
                dimension = int(lengths[0])
                rows = np.empty(batch.num_rows, [("id", "<i8"), ("vector", "<f8", (dimension,))])
                rows["id"], rows["vector"] = ids.to_numpy(), vectors.flatten().to_numpy().reshape(-1, dimension)
                out = out or store.open_output_stream(f"{root}/{name}")
                out.write(rows.tobytes())
                records += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return Written(name, records, dimension)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = place(self.path)
        store.create_dir(root, recursive=True)
        found = {"dimension": 0, "files": []} if self.overwrite else manifest(store, root)
        files = [(m.name, m.records) for m in messages if m is not None and m.records]
        lengths = {m.dimension for m in messages if m is not None and m.records} | ({found["dimension"]} - {0})
        if len(lengths) > 1:
            raise ValueError("vectors of several lengths")
        whole = {"dimension": max(lengths, default=0), "files": [*found["files"], *files]}
        with store.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(whole).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = place(self.path)
        for m in messages:
            if m is not None and m.records:
                store.delete_file(f"{root}/{m.name}")


@dataclass
class Stretch(InputPartition):
    name: str
    first: int
    last: int
    dimension: int


class VectorReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Stretch]:
        store, root = place(self.path)
        found = manifest(store, root)
        step = max(1, STRETCH // (8 + 8 * found["dimension"]))
        return [Stretch(name, lo, min(lo + step, n), found["dimension"]) for name, n in found["files"] for lo in range(0, n, step)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if part is None or not isinstance(part, Stretch):
            return
        store, root = place(self.path)
        kind = np.dtype([("id", "<i8"), ("vector", "<f8", (part.dimension,))])
        step = max(1, BATCH // kind.itemsize)
        with store.open_input_file(f"{root}/{part.name}") as f:
            for lo in range(part.first, part.last, step):
                n = min(step, part.last - lo)
                rows = np.frombuffer(f.read_at(n * kind.itemsize, lo * kind.itemsize), kind)
                cuts = pa.array(np.arange(0, n * part.dimension + 1, part.dimension or 1, dtype=np.int32)[: n + 1])
                yield pa.RecordBatch.from_arrays([pa.array(rows["id"].copy()), pa.ListArray.from_arrays(cuts, pa.array(rows["vector"].ravel()))], names=["id", "vector"])


class VectorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vectorfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> VectorReader:
        return VectorReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options["path"], overwrite)


def write_vectors(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (id long, vector array<double>); all vectors are of one length and without nulls, else the write fails."""
    df.sparkSession.dataSource.register(VectorSource)
    df.select("id", "vector").write.format("vectorfiles").mode(mode).save(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of a store; a path without a manifest has none."""
    spark.dataSource.register(VectorSource)
    return spark.read.format("vectorfiles").load(path)
