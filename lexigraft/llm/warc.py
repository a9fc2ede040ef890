"""WARC as a PySpark data source.

Writing: each task writes one file of records, each a gzip member of its own
whose extra field gives its length (the old "sl" skip-length field), and each
commit writes a manifest of its own of the files that count, so files of failed
attempts are never read and what was written before stays; overwriting drops the
manifests that were there. Reading: files and stretches of files are partitions; only a
member's first bytes are inflated to parse its headers, predicates on headers
are tested there, and a record that they reject is skipped unread. Plain .warc
files and gzip files without the field are read as well.

Register with spark.dataSource.register(WarcSource); the format is "warcfiles".
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import materialise

#: How the names of manifests begin; each ends with .json.
MANIFEST = "_manifest-"
#: Compressed bytes of a read partition, bytes of a batch, of a first look and of a header at most.
STRETCH, BATCH, LOOK, HEADER = 16 << 20, 4 << 20, 2048, 1 << 20
LEVEL = 4
READ_SCHEMA = "record_id string, warc_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string, offset long"
#: Columns whose predicates are decided on the headers, and their header names.
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
_MEMBER = struct.Struct("<4sIBBHccHII")


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address and the path there."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value: str) -> str:
    """A header value in one line: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(row: dict) -> bytes:
    """The bytes of one WARC record: an HTTP answer, or a revisit of one with its headers only."""
    payload = row.get("payload") or b""
    size = row.get("payload_bytes")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = head + (b"" if row["warc_type"] == "revisit" else payload)
    fields = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Target-URI", row.get("target_uri")), ("WARC-Date", row.get("date") or "1970-01-01T00:00:00Z")]
    if row.get("payload_digest"):
        fields.append(("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"))
    if row["warc_type"] == "revisit":
        fields += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member with its compressed and plain length in the extra field."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = _MEMBER.size + len(body) + 8
    head = _MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"s", b"l", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    file: str
    size: int
    starts: list[int]
    records: int


@dataclass
class Stretch(InputPartition):
    file: str
    start: int
    end: int | None

    def __init__(self, file: str, start: int, end: int | None) -> None:
        self.file, self.start, self.end = file, start, end


def manifests(store: fs.FileSystem, root: str) -> list[str]:
    """The manifests of a folder, one for each commit."""
    if store.get_file_info(root).type != fs.FileType.Directory:
        return []
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if posixpath.basename(f.path).startswith(MANIFEST) and f.path.endswith(".json"))


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, compressed: bool, overwrite: bool = False) -> None:
        self.path, self.compressed, self.overwrite = path, compressed, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = place(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compressed
        at, starts, count = 0, [0], 0
        with store.open_output_stream(posixpath.join(root, name), compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = record(row)
                    data = member(data) if self.compressed else data
                    if at - starts[-1] >= STRETCH:
                        starts.append(at)
                    out.write(data)
                    at, count = at + len(data), count + 1
        return Written(name, at, starts, count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = place(self.path)
        store.create_dir(root, recursive=True)
        files = [{"file": m.file, "size": m.size, "starts": m.starts, "records": m.records} for m in messages if m is not None]
        older = manifests(store, root) if self.overwrite else []
        with store.open_output_stream(posixpath.join(root, f"{MANIFEST}{uuid.uuid4().hex}.json"), compression=None) as out:
            out.write(json.dumps(files).encode())
        for path in older:
            store.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files without a manifest are never read; nothing needs undoing."""


class Reader:
    """A window on an open file that reads ahead and can jump."""

    def __init__(self, source, start: int) -> None:
        self.source, self.at, self.buffer = source, start, b""
        self.size = source.size()

    def peek(self, n: int) -> bytes:
        if len(self.buffer) < n and self.at + len(self.buffer) < self.size:
            self.source.seek(self.at + len(self.buffer))
            self.buffer += self.source.read(max(n - len(self.buffer), 1 << 16))
        return self.buffer[:n]

    def skip(self, n: int) -> None:
        self.buffer = self.buffer[n:] if n < len(self.buffer) else b""
        self.at += n


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool, splits: bool = True) -> None:
        self.path, self.payload, self.verify, self.splits = path, payload, verify, splits
        self.wanted: list[tuple[str, str, tuple[str, ...]]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Take equality, membership and beginning of header columns; leave the rest to Spark."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.wanted.append(("in", HEADERS[name], (f.value,)))
            elif name in HEADERS and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.wanted.append(("in", HEADERS[name], tuple(f.value)))
            elif name in HEADERS and isinstance(f, StringStartsWith):
                self.wanted.append(("begins", HEADERS[name], (f.value,)))
            elif name == "warc_type" and isinstance(f, IsNotNull):
                pass
            else:
                yield f

    def accepts(self, headers: dict[str, str]) -> bool:
        for kind, name, values in self.wanted:
            value = self.value(headers, name)
            if value is None or (value not in values if kind == "in" else not value.startswith(values)):
                return False
        return True

    @staticmethod
    def value(headers: dict[str, str], name: str) -> str | None:
        value = headers.get(name)
        if value is not None and name in ("warc-record-id", "warc-refers-to"):
            return value.strip("<>")
        return value.removeprefix("sha1:") if value is not None and name == "warc-payload-digest" else value

    def partitions(self) -> list[InputPartition]:
        store, root = place(self.path)
        known = manifests(store, root)
        if not known:
            info = store.get_file_info(root)
            found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root))
            return [Stretch(f.path, 0, None) for f in sorted(found, key=lambda f: f.path) if f.path.endswith((".warc", ".warc.gz"))]
        files = []
        for path in known:
            with store.open_input_stream(path, compression=None) as source:
                files += json.loads(source.read())
        return [Stretch(posixpath.join(root, f["file"]), a, b) for f in files if f["records"] for a, b in zip(f["starts"], [*f["starts"][1:], f["size"]], strict=True)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64() if n in ("payload_bytes", "offset") else pa.binary() if n == "payload" else pa.string()) for n in (x.split()[0] for x in READ_SCHEMA.split(", "))])
        store, _ = place(self.path)
        rows: list[dict] = []
        held = 0
        with store.open_input_file(partition.file) as source:
            for row in (self.compressed if partition.file.endswith(".gz") else self.plain)(Reader(source, partition.start), partition):
                rows.append(row)
                held += len(row["payload"] or b"")
                if held >= BATCH or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def compressed(self, window: Reader, partition: Stretch) -> Iterator[dict]:
        end = partition.end or window.size
        while window.at < end:
            start, first = window.at, window.peek(LOOK)
            length = 0
            if len(first) >= _MEMBER.size and first[:3] == b"\x1f\x8b\x08" and first[3] == 4 and first[12:14] == b"sl":
                length = _MEMBER.unpack_from(first)[8]
            unpack = zlib.decompressobj(31)
            plain, read = unpack.decompress(first[:length] if length else first), len(first)
            while b"\r\n\r\n" not in plain and not unpack.eof and len(plain) < HEADER:
                piece = window.peek(read + LOOK)[read:]
                if not piece:
                    break
                plain, read = plain + unpack.decompress(piece), read + len(piece)
            head, _, rest = plain.partition(b"\r\n\r\n")
            headers = parse(head)
            if length and not self.accepts(headers):
                window.skip(length)
                continue
            while not unpack.eof:
                piece = window.peek(max(length, read + (1 << 16)))[read:]
                if not piece:
                    raise ValueError(f"{partition.file}: the record at {start} is cut off")
                rest, read = rest + unpack.decompress(piece), read + len(piece)
            window.skip(length or read - len(unpack.unused_data))
            if self.accepts(headers):
                yield self.row(headers, rest[: int(headers.get("content-length", 0))], partition.file, start)

    def plain(self, window: Reader, partition: Stretch) -> Iterator[dict]:
        end = partition.end or window.size
        while window.at < end:
            start, n = window.at, LOOK
            while b"\r\n\r\n" not in window.peek(n) and n < HEADER and window.at + n < window.size:
                n *= 2
            head = window.peek(n).partition(b"\r\n\r\n")[0]
            headers = parse(head)
            size = int(headers.get("content-length", 0))
            window.skip(len(head) + 4)
            block = window.peek(size) if self.accepts(headers) else None
            window.skip(size + 4)
            if block is not None:
                yield self.row(headers, block, partition.file, start)

    def row(self, headers: dict[str, str], block: bytes, file: str, start: int) -> dict:
        out = {column: self.value(headers, name) for column, name in HEADERS.items()}
        head, _, payload = block.partition(b"\r\n\r\n")
        if not headers.get("content-type", "").startswith("application/http"):
            head, payload = b"", block
        sizes = [x.partition(b":")[2] for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
        revisit = out["warc_type"] == "revisit"
        if self.verify and not revisit and out["payload_digest"] not in (None, digest(payload)):
            raise ValueError(f"{file}: the payload at {start} does not fit its digest")
        size = int(sizes[0]) if sizes and revisit else len(payload)
        return out | {"payload_bytes": size, "payload": payload if self.payload and not revisit else None, "file": posixpath.basename(file), "offset": start}


class WarcSource(DataSource):
    """Options: path; payload (true), whether payloads are returned; verify (false), whether digests are checked; compression (gzip or none)."""

    @classmethod
    def name(cls) -> str:
        return "warcfiles"

    def schema(self) -> str:
        return READ_SCHEMA

    def option(self, name: str, default: str) -> str:
        return self.options.get(name, default).lower()

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], self.option("payload", "true") == "true", self.option("verify", "false") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self.option("compression", "gzip") == "gzip", overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


#: Broadcast the list of digests that occur more than once (about 60 bytes each) only up to this many.
BROADCAST_ROWS = 500_000


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record for each row of pages (page_id long, url string, html string), equal payloads as revisits.

    Of equal payloads of at least least_bytes bytes that with the smallest
    page_id is the response; rows that repeat its page_id are responses too. A
    payload whose page_ids are all null is a response each time. Null html
    counts as empty, a null url has no header; other columns don't matter. What
    the folder holds already stays beside the new records.
    """
    spark = pages.sparkSession
    register(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "size": F.length("payload").cast("long")})
    firsts = rows.filter(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    firsts = materialise(firsts, "firsts")
    firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
    rows = rows.join(firsts, "sha", "left")
    revisit = F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull())
    base32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = F.concat(*(F.lpad(F.conv(F.hex(F.substring("sha", i, 5)), 16, 2), 40, "0") for i in (1, 6, 11, 16)))
    letters = F.concat(*(F.substring(F.lit(base32), F.conv(F.substring("bits", 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)))
    rows = rows.withColumn("revisit", revisit).withColumn("bits", bits)
    out = rows.select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))).alias("record_id"),
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.when(F.col("revisit"), F.concat(F.lit("urn:page:"), F.col("first").cast("string"))).alias("refers_to"),
        letters.alias("payload_digest"),
        F.col("size").alias("payload_bytes"),
        F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    )
    out.write.format(WarcSource.name()).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records of a folder or file of WARC; filters on header columns are decided before payloads are read."""
    register(spark)
    return spark.read.format(WarcSource.name()).option("payload", str(payload).lower()).option("verify", str(verify).lower()).load(path)
