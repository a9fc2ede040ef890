"""Word pieces with offsets, overlapping windows over whole documents, and batches of alike lengths."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces that a vocabulary may have at most, as it goes to every task; what stands for a word that no pieces make up.
VOCABULARY, UNKNOWN, INNER = 1_000_000, "[UNK]", "##"


def trie(pieces: list[str]) -> dict:
    """Nested nodes by letter; a node under the empty letter marks a piece's end."""
    root: dict = {}
    for piece in pieces:
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = True
    return root


def cut(word: str, first: dict, inner: dict) -> list[tuple[int, int]] | None:
    """The longest pieces one after another as (start, end), or None if some part isn't one."""
    out, at = [], 0
    while at < len(word):
        node, end = first if at == 0 else inner, 0
        for i in range(at, len(word)):
            node = node.get(word[i])
            if node is None:
                break
            if "" in node:
                end = i + 1
        if not end:
            return None
        out.append((at, end))
        at = end
    return out


def broadcast_pieces(vocabulary: DataFrame) -> Broadcast:
    many = vocabulary.count()
    if many > VOCABULARY:
        raise ValueError(f"{many} pieces; a vocabulary has {VOCABULARY} at most")
    return vocabulary.sparkSession.sparkContext.broadcast([r.piece for r in vocabulary.select("piece").distinct().collect() if r.piece])


def tries(pieces: list[str]) -> tuple[dict, dict]:
    """The trie of pieces at a word's beginning and that of inner ones, without their mark."""
    return trie([p for p in pieces if not p.startswith(INNER)]), trie([p[len(INNER) :] for p in pieces if p.startswith(INNER) and len(p) > len(INNER)])


def word_pieces(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc, start, end, piece, word) of words (doc, word, start, text): the longest match first, inner pieces marked by ##.

    vocabulary is (piece string), inner pieces with their mark. start is the word's
    first character in its document, and pieces' offsets are its characters. A word
    that can't be made up of pieces is one unknown piece; an empty one has none.
    """
    sent = broadcast_pieces(vocabulary)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, inner = tries(sent.value)
        known = lru_cache(1 << 16)(lambda word: cut(word, first, inner))
        for batch in batches:
            rows, starts, ends, names = [], [], [], []
            for i, (start, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                found = known(text) if len(text) <= 200 else cut(text, first, inner)
                for lo, hi in found if found is not None else [(0, len(text))]:
                    rows.append(i)
                    starts.append(start + lo)
                    ends.append(start + hi)
                    names.append(UNKNOWN if found is None else (INNER if lo else "") + text[lo:hi])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(names, pa.string()), batch.column(1).take(at)], names=["doc", "start", "end", "piece", "word"])

    doc = words.schema["doc"].dataType.simpleString()
    rows = words.select("doc", F.col("word").cast("long").alias("word"), F.col("start").cast("long").alias("start"), "text").filter("text <> ''")
    return rows.mapInArrow(each, f"doc {doc}, start long, end long, piece string, word long")


def numbered(pieces: DataFrame, stretch: int = 4_096) -> DataFrame:
    """Pieces with pos, their number in the document from 0; long documents are numbered in stretches of characters."""
    rows = pieces.withColumn("_part", F.floor(F.col("start") / stretch))
    counts = rows.groupBy("doc", "_part").count()
    before = Window.partitionBy("doc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("doc", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("doc", "_part").orderBy("start")) - 1
    return rows.withColumn("_place", place).join(counts, ["doc", "_part"]).withColumn("pos", F.col("_before") + F.col("_place")).drop("_part", "_before", "_place")


def windows(pieces: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc, window, first, pieces, starts, ends): windows of at most `size` pieces, each begun size - overlap pieces after the one before.

    pieces are numbered(); the last window holds the last piece, and none lies inside the one before it.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than a window")
    step = size - overlap
    last = F.floor(F.col("pos") / step)
    first = F.greatest(F.ceil((F.col("pos") - size + 1) / step), F.lit(0))
    rows = pieces.withColumn("window", F.explode(F.sequence(first, last)))
    entry = F.array_sort(F.collect_list(F.struct("pos", "piece", "start", "end")))
    grouped = rows.groupBy("doc", "window").agg(entry.alias("e"))
    of = lambda c: F.transform("e", lambda x: x[c])
    out = grouped.select("doc", "window", (F.col("window") * step).alias("first"), of("piece").alias("pieces"), of("start").alias("starts"), of("end").alias("ends"))
    return out.filter((F.col("window") == 0) | (F.size("pieces") > overlap))


def placed(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of documents (doc, texts), joined by spaces: all words, their starts, and where each document's words begin."""
    texts = batch.column(1)
    words = texts.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)])
    return words, ends[:-1] - np.repeat(ends[bounds[:-1]], np.diff(bounds)), bounds


def document_words(docs: DataFrame) -> DataFrame:
    """(doc, word, start, text): the words of documents (doc, texts array<string>), in no shuffle; start is a character of the joined text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, starts, bounds = placed(batch)
            many = np.diff(bounds)
            at = pa.array(np.repeat(np.arange(len(many)), many))
            place = np.arange(len(starts)) - np.repeat(bounds[:-1], many)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(place), pa.array(starts), words], names=["doc", "word", "start", "text"])

    doc = docs.schema["doc"].dataType.simpleString()
    return docs.select("doc", "texts").filter("texts is not null").mapInArrow(each, f"doc {doc}, word long, start long, text string")


#: Words that a task cuts at a time; a longer document is cut by itself.
STRIDE = 200_000


def document_windows(docs: DataFrame, vocabulary: DataFrame, size: int, overlap: int) -> DataFrame:
    """windows() of the numbered() word_pieces() of documents (doc, texts array<string>, its words), each document whole in its row, so nothing is shuffled."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than a window")
    step, sent = size - overlap, broadcast_pieces(vocabulary)
    first_of = lambda many: np.cumsum(many) - many
    runs = lambda begin, many: np.arange(many.sum()) + np.repeat(begin - first_of(many), many)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, inner = tries(sent.value)
        known = lru_cache(1 << 16)(lambda word: cut(word, first, inner))

        def cut_all(ids: pa.Array, words: pa.Array, starts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            """Each distinct word is cut once; its pieces are then repeated wherever it stands."""
            coded = words.dictionary_encode()
            names, los, his, many = [], [], [], []
            for text in coded.dictionary.to_pylist():
                found = known(text) if len(text) <= 200 else cut(text, first, inner)
                for lo, hi in found if found is not None else [(0, len(text))]:
                    names.append(UNKNOWN if found is None else (INNER if lo else "") + text[lo:hi])
                    los.append(lo)
                    his.append(hi)
                many.append(len(names))
            many = np.diff(np.array([0, *many], np.int64))
            code = coded.indices.to_numpy().astype(np.int64)
            at, start = runs(first_of(many)[code], many[code]), np.repeat(starts, many[code])
            upto = np.concatenate([[0], np.cumsum(many[code])])
            n = upto[bounds[1:]] - upto[bounds[:-1]]
            windows_of = np.where(n > 0, np.maximum(1, -(-(n - overlap) // step)), 0)
            row = np.repeat(np.arange(len(n)), windows_of)
            window = runs(np.zeros_like(n), windows_of)
            length = np.minimum(size, n[row] - window * step)
            flat = runs(upto[bounds[:-1]][row] + window * step, length)
            ends = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
            of = lambda values: pa.ListArray.from_arrays(ends, values)
            place = lambda values: of(pa.array((np.array(values, np.int64)[at] + start)[flat]))
            pieces = of(pa.array(names, pa.string()).take(pa.array(at[flat])))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(window), pa.array(window * step), pieces, place(los), place(his)], names=["doc", "window", "first", "pieces", "starts", "ends"])

        for batch in batches:
            words, starts, bounds = placed(batch)
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + STRIDE, "right")) - 1)
                a, b = int(bounds[lo]), int(bounds[hi])
                yield cut_all(batch.column(0).slice(lo, hi - lo), words.slice(a, b - a), starts[a:b], bounds[lo : hi + 1] - a)
                lo = hi

    doc = docs.schema["doc"].dataType.simpleString()
    own = docs.select("doc", "texts").filter("texts is not null")
    return own.mapInArrow(each, f"doc {doc}, window long, first long, pieces array<string>, starts array<long>, ends array<long>")


def batches(rows: DataFrame, size: int, width: int = 64, length: Column | None = None) -> DataFrame:
    """Windows with bucket, batch, width and padding: rows of alike lengths are batched and filled up to the longest of the batch.

    A bucket is a stretch of `width` lengths. Rows are dealt to a bucket's parts by a
    hash, as many parts as give each some 64 batches, and batched within them in hash order, so
    no bucket is one task. The last batch of a part may be short.
    """
    n = F.size("pieces") if length is None else length
    rows = rows.withColumns({"_n": n, "bucket": F.ceil(n / width)})
    parts = rows.groupBy("bucket").agg(F.greatest(F.floor(F.count("*") / (64 * size)), F.lit(1)).alias("_parts"))
    hashed = F.xxhash64("doc", "window")
    dealt = rows.join(F.broadcast(parts), "bucket").withColumn("_part", F.pmod(hashed, F.col("_parts")))  # a row for each bucket, a window's size over the width at most
    place = F.row_number().over(Window.partitionBy("bucket", "_part").orderBy(hashed, "doc", "window")) - 1
    dealt = dealt.withColumn("_place", F.floor(place / size))
    longest = F.max("_n").over(Window.partitionBy("bucket", "_part", "_place"))  # lies as the parts do, so rows are shuffled once
    out = dealt.withColumns({"batch": F.concat_ws("-", "bucket", "_part", "_place"), "width": longest}).withColumn("padding", F.col("width") - F.col("_n"))
    return out.drop("_n", "_part", "_parts", "_place")


#: Characters of a stretch, in which spans and windows are brought together.
STRETCH = 4_096


def stretched(rows: DataFrame, each: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, list[pa.Array]]], fields: str) -> DataFrame:
    """(doc, stretch, value struct<fields>): what `each` makes of a batch of rows whose first column is doc: rows, their stretches, and the fields."""
    doc = rows.schema["doc"].dataType.simpleString()

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at, stretch, values = each(batch)
                value = pa.StructArray.from_arrays(values, names=[f.split(":")[0] for f in fields.split(", ")])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(stretch.astype(np.int64)), value], names=["doc", "stretch", "value"])

    return rows.mapInArrow(all_, f"doc {doc}, stretch long, value struct<{fields}>")


def located(spans: DataFrame, rows: DataFrame, reach: int | None = None) -> DataFrame:
    """(doc, span, window, first, last, from, to) of spans (doc, span, start, end): their pieces in the first window that holds them whole.

    rows are windows() or document_windows(). first and last are places in the
    window's lists, from and to the pieces' first and last character. A span that
    no window holds whole is in the window that holds its first piece, and last
    goes on counting into the windows after that one. A span that touches no
    piece has no row. Documents may be null.

    Spans meet the windows of their stretch of characters only, in one shuffle to
    which pieces go as their distances. reach: characters of a span at most, counted if it isn't given.
    """
    own = spans.select("doc", "span", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).filter("start is not null and end is not null")
    if reach is None:
        reach = own.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    reach, size = max(reach or 0, 1), STRETCH
    span = spans.schema["span"].dataType.simpleString()

    def spans_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
        """A row for each run of spans of one document and stretch."""
        doc = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        start, end = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        if (end - start).max() > reach:
            raise ValueError(f"a span of {(end - start).max()} characters; they have {reach} at most")
        stretch = start // size
        at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (stretch[1:] != stretch[:-1])]))
        ends = pa.array(np.append(at, len(start)), pa.int32())
        of = lambda values: pa.ListArray.from_arrays(ends, values)
        return at, stretch[at], [of(batch.column(1)), of(pa.array(start - stretch * size, pa.int32())), of(pa.array(end - start))]

    def windows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
        """A row for each window and stretch in which a span that it touches may begin."""
        starts, ends = batch.column(3), batch.column(4)
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(starts).to_numpy())])
        begin, end = starts.flatten().to_numpy(), ends.flatten().to_numpy()
        low = begin[upto[:-1]]
        first, last = np.maximum(low - reach, 0) // size, (end[upto[1:] - 1] - 1) // size
        many = last - first + 1
        at = np.repeat(np.arange(len(low)), many)
        steps = np.diff(begin, prepend=0)
        steps[upto[:-1]] = 0
        of = lambda values: pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(values)).take(pa.array(at))
        return at, np.arange(len(at)) - np.repeat(np.cumsum(many) - many - first, many), [batch.column(1).cast(pa.int64()).take(pa.array(at)), batch.column(2).cast(pa.int64()).take(pa.array(at)), pa.array(low[at]), of(steps), of(end - begin)]

    kinds = f"spans: array<{span}>, starts: array<int>, lengths: array<bigint>", "window: bigint, first: bigint, low: bigint, steps: array<bigint>, lengths: array<bigint>"
    some = rows.select("doc", "window", "first", F.col("starts").cast("array<bigint>").alias("starts"), F.col("ends").cast("array<bigint>").alias("ends")).filter("size(starts) > 0")
    left, right = stretched(own, spans_of, kinds[0]), stretched(some, windows_of, kinds[1])
    none = lambda kind: F.lit(None).cast(f"struct<{kind}>")
    both = left.select("doc", "stretch", F.col("value").alias("s"), none(kinds[1]).alias("w")).union(right.select("doc", "stretch", none(kinds[0]).alias("s"), F.col("value").alias("w")))
    met = both.groupBy("doc", "stretch").agg(F.collect_list("s").alias("s"), F.array_sort(F.collect_list("w")).alias("w")).filter("size(s) > 0 and size(w) > 0")
    doc = spans.schema["doc"].dataType.simpleString()
    return met.mapInArrow(lambda batches: meet(batches, size), f"doc {doc}, span {span}, window long, first int, last int, from long, to long")


def meet(batches: Iterator[pa.RecordBatch], characters: int) -> Iterator[pa.RecordBatch]:
    """located() of rows (doc, stretch, runs of spans, windows in their order), stretches having so many characters."""
    numbers = lambda array: array.to_numpy(zero_copy_only=False).astype(np.int64)
    per_row = lambda lists: numbers(pc.list_value_length(lists))

    for batch in batches:
        runs, w = batch.column(2).flatten(), batch.column(3).flatten()
        # a group is a row; spans and windows lie group by group
        size = per_row(runs.field("spans"))
        group = np.repeat(np.repeat(np.arange(len(batch)), per_row(batch.column(2))), size)
        start = numbers(runs.field("starts").flatten()) + numbers(batch.column(1))[group] * characters
        end = start + numbers(runs.field("lengths").flatten())
        of = np.repeat(np.arange(len(batch)), per_row(batch.column(3)))
        count, low, first = per_row(w.field("steps")), numbers(w.field("low")), numbers(w.field("first"))
        at = np.concatenate([[0], np.cumsum(count)])
        moved = np.concatenate([[0], np.cumsum(numbers(w.field("steps").flatten()))])
        begins = moved[1:] - np.repeat(moved[at[:-1] + 1], count) + np.repeat(low, count)
        ends = begins + numbers(w.field("lengths").flatten())
        high = ends[at[1:] - 1]

        # places count from the group's first, so that one search serves all groups, and another one all windows
        base = np.minimum.reduceat(low, np.flatnonzero(np.diff(of, prepend=-1)))
        base = np.minimum(base, np.minimum.reduceat(start, np.flatnonzero(np.diff(group, prepend=-1))))
        start, end, owner = start - base[group], end - base[group], np.repeat(np.arange(len(count)), count)
        low, high, begins, ends = low - base[of], high - base[of], begins - base[of][owner], ends - base[of][owner]
        wide = int(max(high.max(), end.max())) + 2
        lows, highs, all_begins, all_ends = of * wide + low, of * wide + high, owner * wide + begins, owner * wide + ends

        last_of = np.searchsorted(of, group, "right") - 1
        holds = np.minimum(np.searchsorted(highs, group * wide + end), last_of)  # the first window that ends late enough
        whole = (low[holds] <= start) & (high[holds] >= end)
        window = np.where(whole, holds, np.searchsorted(highs, group * wide + start, "right"))
        until = np.where(whole, holds, np.searchsorted(lows, group * wide + end) - 1)
        there = (window <= last_of) & (until >= window)
        group, start, end, window, until = (x[there] for x in (group, start, end, window, until))
        a = np.searchsorted(all_ends, window * wide + start, "right")
        b = np.searchsorted(all_begins, until * wide + end) - 1
        a, b = np.minimum(a, at[window + 1] - 1), np.maximum(b, at[until])
        touched = (begins[a] < end) & (ends[a] > start) & (begins[b] < end) & (ends[b] > start)
        group, window, until, a, b = (x[touched] for x in (group, window, until, a, b))
        columns = [
            batch.column(0).take(pa.array(group)), runs.field("spans").flatten().filter(pa.array(there)).filter(pa.array(touched)), w.field("window").take(pa.array(window)),
            pa.array(a - at[window], pa.int32()), pa.array(b - at[until] + first[until] - first[window], pa.int32()), pa.array(begins[a] + base[group]), pa.array(ends[b] + base[group]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "span", "window", "first", "last", "from", "to"])
