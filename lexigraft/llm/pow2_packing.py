"""Packing by power-of-two decomposition.

A document's ids, with the end id, are cut into blocks of the greatest length
and then into the powers of two of what remains, largest first. Each piece is a
sequence of its own, so none crosses documents and none needs padding; pieces
of one length form a bucket, from which batches of equal shape are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder
from .words import text_buffers

SEQUENCE = 2048
#: Bytes of text that are handled together.
SLICE = 1 << 20


def lengths(n: int, longest: int = SEQUENCE) -> list[int]:
    """The pieces of n ids: blocks of `longest`, then the binary digits of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def decompose(docs: DataFrame, tokenizer: str, longest: int = SEQUENCE, end_id: int = 1) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (packed uint32), doc_tokens.

    docs needs doc_id long and text string; other columns don't matter. Null and
    empty texts give one piece that holds the end id. Rows that repeat a doc_id
    are cut each for itself. An empty table gives no rows.
    """
    if longest & (longest - 1):
        raise ValueError("the greatest length must be a power of two")
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            data, ids = data.tobytes(), batch.column(0).to_pylist()
            at = 0
            while at < len(ids):
                stop = at + 1
                while stop < len(ids) and offsets[stop + 1] - offsets[at] <= SLICE:
                    stop += 1
                texts = [data[offsets[i] : offsets[i + 1]] for i in range(at, stop)]
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc_id, packed in zip(ids[at:stop], tokens.encode_all(texts), strict=True):
                    packed += end
                    total, start = len(packed) // 4, 0
                    for n in lengths(total, longest):
                        for column, value in zip(out, (doc_id, start, n, packed[4 * start : 4 * (start + n)], total), strict=True):
                            column.append(value)
                        start += n
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens"])
                at = stop

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long")


def sequences(pieces: DataFrame) -> DataFrame:
    """Number the pieces: the length's bucket is in the id's high bits, so that each bucket is one range of ids."""
    bucket = F.log2(F.col("length")).cast("long")
    return pieces.withColumns({"sequence_id": F.shiftleft(bucket, 58) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def pack(docs: DataFrame, tokenizer: str, longest: int = SEQUENCE, end_id: int = 1) -> DataFrame:
    """decompose() and sequences() in one: pieces with their ids, sequence_id and offset."""
    return sequences(decompose(docs, tokenizer, longest, end_id))
