"""Words of Arrow text columns as NumPy arrays.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. Every word gets
a 64-bit hash: a sum of random values of its bytes times powers of an odd
number, which prefix sums give for all words of a batch at once, then mixed.
Two given words share a hash with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 18
BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


LENGTH = np.uint64(0xD6E8FEB86659FD93)
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
_CASED = np.arange(256)
_LOWER = _CASED.copy()
_LOWER[65:91] += 32
_VALUES = {
    False: mix64((_CASED.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)),
    True: mix64((_LOWER.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)),
}
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64, for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * SEGMENT)
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[key] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes; a longer text is a run alone."""
    data, offsets = text_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool, between: np.ndarray = WHITE, values: np.ndarray | None = None, prefixes: tuple[int, ...] = ()):
    """Row, first byte, end byte and hash of every word, in order.

    between: marks of the bytes that part words. values: another value for each
    byte. prefixes: also give a list of hashes of each word's first so many bytes.
    """
    n = len(data)
    white = between[data]
    begin = ~white
    begin[1:] &= white[:-1]
    last = ~white
    last[:-1] &= white[1:]
    inner = np.unique(offsets[(offsets > 0) & (offsets < n)])
    begin[inner] = ~white[inner]
    last[inner - 1] = ~white[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    hashes, heads = span_hashes(data, starts, ends, _VALUES[lower] if values is None else values, prefixes)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return (rows, starts, ends, hashes, heads) if prefixes else (rows, starts, ends, hashes)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUES[False], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """The hashes of the byte spans [start, end), given in order, and of the first so many bytes of each; memory is a segment's."""
    hashes = np.empty(len(starts), np.uint64)
    heads = [np.empty(len(starts), np.uint64) for _ in prefixes]
    word = 0
    while word < len(starts):
        at = int(starts[word])
        stop = max(word + 1, int(np.searchsorted(ends, at + SEGMENT, "right")))
        end = int(ends[stop - 1])
        up, down = powers(end - at)
        sums = np.zeros(end - at + 1, np.uint64)
        np.cumsum(values[data[at:end]] * up[: end - at], out=sums[1:])
        s, e = starts[word:stop] - at, ends[word:stop] - at
        hashes[word:stop] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * LENGTH)
        for size, out in zip(prefixes, heads, strict=True):
            cut = np.minimum(e, s + size)
            out[word:stop] = mix64((sums[cut] - sums[s]) * down[s] + (cut - s).astype(np.uint64) * LENGTH)
        word = stop
    return hashes, heads


def runs(rows: np.ndarray, n: int) -> np.ndarray:
    """n + 1 borders of the rows' words in a sorted row number column."""
    return np.searchsorted(rows, np.arange(n + 1))


def grams(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of `size` words within a row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, rows.dtype)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(0xC6A4A7935BD1E995)
        out += hashes[i : i + n]
    whole = rows[:n] == rows[size - 1 :]
    return mix64(out[whole] + np.uint64(size)), rows[:n][whole]


def counts(mask: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How many of a mask's marks lie between each two borders."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[borders[1:]] - total[borders[:-1]]


def values_of(table: np.ndarray) -> np.ndarray:
    """Byte values for words() under which bytes count as the bytes that `table` maps them to."""
    return _VALUES[False][table]
