"""SentencePiece encoding by an Aho-Corasick automaton and a single-pass Viterbi, and decoding.

Trie nodes of all pieces have failure links and output links; the pass reads a
text once, and at each position it follows the output links, longest piece
first, to relax the best segmentation that ends there. In a unigram model the
best has the greatest sum of scores. In a BPE model sums mean nothing: a
position's best is the one whose last two pieces BPE itself would leave apart,
which is unique, so the pass gives the library's ids. A character that no piece
covers costs the unknown penalty and becomes its byte pieces.

A model's pieces hold the space mark only at their beginning, so a text parts
into chunks before such marks, and characters of no longer piece stand alone.
Chunks are segmented once in a Python worker and remembered; a model with other
pieces is handled too, its texts are then one chunk each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import text_buffers

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks that a worker remembers (about 180 bytes each) and their characters; the store is emptied when full.
STORE, STORE_CHARS = 1_000_000, 24 << 20
#: Bytes of text handled together.
SLICE = 1 << 20
_models: dict[str, Model] = {}


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, message[at : at + size]
            at += size


def is_bpe(proto: bytes) -> bool:
    """The trainer's model type, 1 for unigram and 2 for BPE."""
    trainer = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(trainer) if k == 3), 1) == 2


class Model:
    """Pieces, scores and kinds of a SentencePiece model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        self.unk = lib.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.scores = {i: lib.get_score(i) for i in self.plain}
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        with open(path, "rb") as file:
            self.bpe = is_bpe(file.read())
        self.ids = {self.pieces[i]: i for i in reversed(self.plain)}
        self.apart: dict[int, bool] = {}
        self.build()
        inside = {c for i in self.plain if len(self.pieces[i]) > 1 for c in self.pieces[i]}
        self.whole = any(MARK in self.pieces[i].lstrip(MARK) for i in self.plain)
        letters = "".join(map(re.escape, sorted(inside - {MARK})))
        self.chunk = re.compile(f"{MARK}*[{letters}]+|{MARK}+|[^{MARK}{letters}]" if letters else f"{MARK}+|[^{MARK}]")
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0
        self.texts = [self.surface(i) for i in range(n)]

    def build(self) -> None:
        """The automaton: children, failure link, own piece and output link of each node."""
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.piece, self.out, depth = [0], [-1], [0], [0]
        for i in self.plain:
            at = 0
            for c in self.pieces[i]:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.piece.append(-1)
                    self.out.append(0)
                    depth.append(depth[at] + 1)
                at = self.next[at][c]
            if self.piece[at] < 0:
                self.piece[at] = i
        queue = list(self.next[0].values())
        for at in queue:
            for c, child in self.next[at].items():
                link = self.fail[at]
                while link and c not in self.next[link]:
                    link = self.fail[link]
                self.fail[child] = self.next[link].get(c, 0)
                queue.append(child)
            link = self.fail[at]
            self.out[at] = link if self.piece[link] >= 0 else self.out[link]
        self.ends: list[tuple[tuple[int, float, int], ...]] = []
        for at in range(len(self.next)):  # the output links of a node, longest piece first
            found, node = [], at if self.piece[at] >= 0 else self.out[at]
            while node:
                found.append((depth[node], self.scores[self.piece[node]], self.piece[node]))
                node = self.out[node]
            self.ends.append(tuple(found))

    def segment(self, text: str) -> list[int]:
        """The ids of the best segmentation; among equal ones that whose last piece begins first."""
        if self.bpe:
            return self.segment_bpe(text)
        children, fail, ends = self.next, self.fail, self.ends
        best, back = [0.0], [(0, -1)]
        at = 0
        for here, c in enumerate(text, 1):
            while at and c not in children[at]:
                at = fail[at]
            at = children[at].get(c, 0)
            top, way = None, (1, -1)
            single = False
            for length, score, piece in ends[at]:
                single = length == 1
                value = best[here - length] + score
                if top is None or value > top:
                    top, way = value, (length, piece)
            if not single:
                value = best[here - 1] + self.unknown
                if top is None or value > top:
                    top, way = value, (1, -1)
            best.append(top)
            back.append(way)
        return self.traced(text, back)

    def traced(self, text: str, back: list[tuple[int, int]]) -> list[int]:
        """The ids along the back pointers (length, piece) from the end; -1 is an unknown character."""
        ids: list[int] = []
        here = len(text)
        while here:
            length, piece = back[here]
            here -= length
            if piece >= 0:
                ids.append(piece)
            elif self.bytes:
                ids += [self.bytes[b] for b in reversed(text[here].encode())]
            elif not (ids and ids[-1] == self.unk):
                ids.append(self.unk)
        return ids[::-1]

    def merged(self, text: str) -> list[str]:
        """BPE from its definition: join the adjacent pair of the best score, leftmost first, until none is left."""
        parts = list(text)
        while True:
            pairs = [(-self.scores[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not pairs:
                return parts
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def stays(self, before: int, piece: int) -> bool:
        """Whether BPE leaves these two pieces apart (before: -1 at the beginning or after an unknown character)."""
        ends = [self.pieces[before], self.pieces[piece]] if before >= 0 else [self.pieces[piece]]
        if len(self.apart) > STORE:
            self.apart.clear()
        found = self.apart[before << 32 | piece] = self.merged("".join(ends)) == ends
        return found

    def segment_bpe(self, text: str) -> list[int]:
        children, fail, ends, apart = self.next, self.fail, self.ends, self.apart
        back = [(0, -1)]
        at = 0
        for here, c in enumerate(text, 1):
            while at and c not in children[at]:
                at = fail[at]
            at = children[at].get(c, 0)
            way = (1, -1)
            for length, _, piece in ends[at]:
                before = back[here - length][1]
                known = apart.get(before << 32 | piece)
                if known or known is None and self.stays(before, piece):
                    way = (length, piece)
                    break
            back.append(way)
        return self.traced(text, back)

    def chunks(self, text: str) -> bytes:
        parts = self.chunk.findall(text)
        if len(parts) == 1:
            return np.array(self.segment(text), "<u4").tobytes()
        known = self.known
        for c in parts:
            if c not in known:
                known[c] = np.array(self.segment(c), "<u4").tobytes()
                self.held += len(c)
        return b"".join([known[c] for c in parts])

    def encode(self, text: str) -> bytes:
        """Ids of a normalised text, packed as little-endian unsigned 32-bit numbers."""
        if self.whole:
            return np.array(self.segment(text), "<u4").tobytes()
        if len(self.known) + len(self.words) > STORE or self.held > STORE_CHARS:
            self.known.clear()
            self.words.clear()
            self.held = 0
        if MARK * 2 in text or not text.startswith(MARK):
            return self.chunks(text)
        words, parts = self.words, text.split(MARK)[1:]  # the words after each mark
        try:
            return b"".join([words[w] for w in parts])
        except KeyError:
            new = set(parts).difference(words)
            self.held += sum(map(len, new))
            words.update((w, self.chunks(MARK + w)) for w in new)
        return b"".join([words[w] for w in parts])

    def normalise(self, texts: list[str]) -> list[str]:
        """The model's own normalisation: character map, space marks, added first mark."""
        return [self.library.normalize(t) for t in texts]

    def surface(self, piece: int) -> bytes:
        if self.library.is_byte(piece):
            return bytes([int(self.pieces[piece][3:5], 16)])
        if self.library.is_control(piece):
            return b""
        return (" ⁇ " if piece == self.unk else self.pieces[piece].replace(MARK, " ")).encode()

    def decode(self, packed: bytes) -> str:
        """The text of packed ids, without the first space that encoding added."""
        out = b"".join([self.texts[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """One row per document: doc_id, ids (packed uint32), n_tokens, and with `decoded` the text of the ids.

    docs needs doc_id and text; other columns don't matter. A null text counts
    as empty and has no ids. Rows that repeat come back each. An empty table
    gives no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            at, n = 0, batch.num_rows
            while at < n:
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
                texts = batch.column(1).slice(at, end - at).fill_null("").to_pylist()
                packed = [m.encode(t) for t in m.normalise(texts)]
                columns = [batch.column(0).slice(at, end - at), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
                if decoded:
                    columns.append(pa.array([m.decode(p) for p in packed]))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "decoded"][: len(columns)])
                at = end

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(each, "doc_id long, ids binary, n_tokens long" + ", decoded string" * decoded)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of packed ids (doc_id, ids); null ids give an empty text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(p or b"") for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(each, "doc_id long, text string")
