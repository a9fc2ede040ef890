"""A lossless counting quotient filter of packed word-id n-grams, on NumPy arrays.

A key of k ids of `bits` bits each is packed in lanes of two ids. An invertible
permutation spreads the first lane over its 2 * bits bits: the other lanes' hash is
added bit by bit, then the lane is mixed one to one. Its leading bits are the quotient,
a place in the filter that costs two bits; its other bits and the other lanes are
the remainder, kept whole, so every key comes back. Entries are sorted by quotient
and remainder, so filters of the same keys' width merge like sorted lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from .words import mix64

_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << 2 * bits) - 1)


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Rows of ids (n, k), each below 2**bits, as lanes (n, ceil(k / 2)); bits is 32 at most."""
    n, k = ids.shape
    wide = np.zeros((n, (k + 1) // 2 * 2), np.uint64)
    wide[:, :k] = ids
    return wide[:, 0::2] << np.uint64(bits) | wide[:, 1::2]


def unpack(lanes: np.ndarray, k: int, bits: int) -> np.ndarray:
    both = np.stack([lanes >> np.uint64(bits), lanes & np.uint64((1 << bits) - 1)], axis=2)
    return both.reshape(len(lanes), -1)[:, :k].astype(np.int64)


def _rest(lanes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lanes), np.uint64)
    for i in range(1, lanes.shape[1]):
        out = mix64(out + lanes[:, i] + np.uint64(i))
    return out


def permute(lanes: np.ndarray, bits: int) -> np.ndarray:
    """Permuted keys; the first lane stands at the top of its 64 bits."""
    out, mask, half = lanes.copy(), _mask(bits), np.uint64(bits)
    x = out[:, 0] ^ (_rest(lanes) & mask)
    for factor in _FACTORS:
        x ^= x >> half
        x = x * np.uint64(factor) & mask
    out[:, 0] = (x ^ (x >> half)) << np.uint64(64 - 2 * bits)
    return out


def restore(keys: np.ndarray, bits: int) -> np.ndarray:
    """The inverse of permute."""
    out, mask, half = keys.copy(), _mask(bits), np.uint64(bits)
    x = out[:, 0] >> np.uint64(64 - 2 * bits)
    x ^= x >> half
    for factor in reversed(_FACTORS):
        x = x * np.uint64(pow(factor, -1, 1 << 64)) & mask
        x ^= x >> half
    out[:, 0] = x ^ (_rest(keys) & mask)
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, equal ones as one with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    first = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    return keys[first], np.add.reduceat(counts, np.flatnonzero(first))


@dataclass
class Filter:
    """Permuted keys in order with their counts; the first `skip` bits of all of them are `prefix`.

    The stored form has a bit for each quotient that has a run, a bit for each entry
    that ends a run, remainders by bytes without those that are 0 throughout, and a
    byte for each count, with counts over 254 apart.
    """

    keys: np.ndarray
    counts: np.ndarray
    bits: int
    skip: int = 0
    prefix: int = 0

    @staticmethod
    def of(lanes: np.ndarray, bits: int) -> Filter:
        """The filter of packed keys, repeated ones counted."""
        return Filter(*summed(permute(lanes, bits), np.ones(len(lanes), np.int64)), bits)

    @staticmethod
    def merged(filters: list[Filter]) -> Filter:
        """The filter of all, which are of equal bits, skip and prefix."""
        one = filters[0]
        if len(filters) == 1:
            return one
        return Filter(*summed(np.concatenate([f.keys for f in filters]), np.concatenate([f.counts for f in filters])), one.bits, one.skip, one.prefix)

    def entries(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (n, k) and counts."""
        return unpack(restore(self.keys, self.bits), k, self.bits), self.counts

    def split(self, bits: int) -> Iterator[Filter]:
        """The parts of equal first `bits` bits, in order; empty ones are left out."""
        heads = self.keys[:, 0] >> np.uint64(64 - bits) if bits else np.zeros(len(self.keys), np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]])) if len(heads) else np.zeros(0, int)
        for lo, hi in zip(starts, [*starts[1:], len(heads)], strict=True):
            yield Filter(self.keys[lo:hi], self.counts[lo:hi], self.bits, bits, int(heads[lo]))

    def encode(self) -> bytes:
        n = len(self.keys)
        room = 2 * self.bits - self.skip
        q = min(max(n.bit_length(), 3), room)  # about a slot for each entry
        own = self.keys[:, 0] << np.uint64(self.skip) if self.skip < 64 else np.zeros(n, np.uint64)
        quotient = own >> np.uint64(64 - q) if q else np.zeros(n, np.uint64)
        remainder = own << np.uint64(q) if q < 64 else np.zeros(n, np.uint64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        ends = np.ones(n, bool)
        ends[:-1] = quotient[1:] != quotient[:-1]
        planes = np.ascontiguousarray(np.concatenate([remainder[:, None], self.keys[:, 1:]], axis=1)).view(np.uint8).T
        used = planes.any(axis=1)
        small = np.minimum(self.counts, 255).astype(np.uint8)
        head = np.array([n, len(planes), q, self.bits, self.skip, self.prefix], np.uint64)
        return b"".join(x.tobytes() for x in (head, np.packbits(used), np.packbits(occupied), np.packbits(ends), np.ascontiguousarray(planes[used]), small, self.counts[small == 255]))

    @staticmethod
    def decode(data: bytes) -> Filter:
        n, wide, q, bits, skip, prefix = (int(x) for x in np.frombuffer(data, np.uint64, 6))
        at = 48

        def take(count: int, kind: type = np.uint8) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        marks = lambda count: np.unpackbits(take(-(-count // 8)), count=count)
        used = marks(wide).astype(bool)
        occupied = np.flatnonzero(marks(1 << q))
        ends = marks(n).astype(np.int64)
        planes = np.zeros((wide, n), np.uint8)
        planes[used] = take(n * int(used.sum())).reshape(-1, n)
        keys = np.ascontiguousarray(planes.T).view(np.uint64).reshape(n, wide // 8)
        run = np.cumsum(ends) - ends  # as many runs have ended before an entry as come before its own
        own = occupied[run].astype(np.uint64) << np.uint64(64 - q) if q else np.zeros(n, np.uint64)
        own |= keys[:, 0] >> np.uint64(q) if q < 64 else np.uint64(0)
        keys[:, 0] = (own >> np.uint64(skip) | np.uint64(prefix << (64 - skip)) if skip < 64 else np.uint64(prefix)) if skip else own
        counts = take(n).astype(np.int64)
        counts[counts == 255] = np.frombuffer(data, np.int64, int((counts == 255).sum()), at)
        return Filter(keys, counts, bits, skip, prefix)

    def count(self, key: np.ndarray) -> int:
        """The count of one packed key (lanes), 0 if it isn't there."""
        wanted = permute(key.reshape(1, -1), self.bits)[0]
        lo, hi = np.searchsorted(self.keys[:, 0], wanted[0], "left"), np.searchsorted(self.keys[:, 0], wanted[0], "right")
        found = np.flatnonzero((self.keys[lo:hi] == wanted).all(axis=1))
        return int(self.counts[lo + found[0]]) if len(found) else 0
