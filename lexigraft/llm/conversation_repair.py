"""Repair of conversation structure by iterative-deepening A*.

Rows of a conversation, in order, are kept, given another role, or deleted, and
empty turns are put in between, until the roles read: at most one system turn,
then user and assistant in turns, ending with the assistant, or nothing. The
cheapest edits are searched depth first, in ASCII order of their initials, under a
bound that grows to the least estimate beyond it; a table holds, for each place and
grammar state, the largest rest of the bound that has failed there. So the first
path that is accepted is a cheapest one, and of those the least in ASCII order. The
estimate is the cost of the rest in a grammar that doesn't tell "after the system
turn" from "after the assistant", which never costs more than the true rest.

Rows that have to go lie in runs, which are one step of the search: deleting
before inserting is always the lesser of two equal paths.

A conversation isn't bound to one task: equal rows are counted first, all rows are
dealt by ranges of their order, and pieces of at most SEGMENT rows are searched.
Conversations of one piece, nearly all, are done there. For longer ones each piece
tells what it costs from each state to each; these few numbers give what the rest
costs at every piece's end, with which the pieces are searched apart, from the
state in which the piece before them ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: Different rows of a piece at most.
SEGMENT = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar states: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial, by state; where a turn that is put in or given another role leads.
ON = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
NEVER = 1 << 60
#: Costs of the rest at the end of a conversation.
DONE = (0, NEVER, NEVER, 0)
_WHITE = r"\x20\x09-\x0D"

#: An element is (run of rows that have to go, initial, truncated): a run of 0 is a row that may stay.
Element = tuple[int, str, bool]


def moves(element: Element | None, state: int) -> list[tuple[str, int, bool, int]]:
    """(initials, cost, whether the element is done, state) of the edits, in ASCII order."""
    insert = ("I", INSERT, False, NEXT[state])
    if element is None:
        return [insert]
    run, initial, truncated = element
    if run:
        return [("D" * run, DELETE * run, True, state), insert]
    out = [("D", DELETE, True, state), insert]
    if initial in ON[state]:
        out.append(("K", KEEP + TRUNCATED * truncated, True, ON[state][initial]))
    return [*out, ("R", REROLE + TRUNCATED * truncated, True, NEXT[state])]


def rest_costs(elements: list[Element], end: tuple[int, ...], last: bool) -> list[list[int]]:
    """For each place and state the least cost of what follows, from the costs at the end."""
    rows = [list(end)]
    for element in ([None] if last else []) + elements[::-1]:
        after, here = rows[-1], [NEVER] * 4
        if element is None:
            here = list(after)
        else:
            for state in range(4):
                here[state] = min(cost + after[to] for _, cost, done, to in moves(element, state) if done)
        for _ in range(2):  # two turns put in lead back to the same role
            here = [min(here[s], INSERT + here[NEXT[s]]) for s in range(4)]
        if element is None:
            rows[0] = here
        else:
            rows.append(here)
    return rows[::-1]


def estimates(elements: list[Element], end: tuple[int, ...], last: bool) -> list[list[int]]:
    """Costs of the rest where the system turn and the assistant are one state; never above the true ones."""
    both = min(end[SYSTEM], end[ASSISTANT])
    return rest_costs(elements, (end[START], both, end[USER], both), last)


def search(elements: list[Element], state: int = START, end: tuple[int, ...] = DONE, last: bool = True) -> tuple[str, int, int]:
    """(initials of the edits, their cost, the state at the end) of the first of the cheapest paths.

    end: what the rest costs from each state; only the last piece puts turns in at its end.
    """
    n = len(elements)
    guess = estimates(elements, end, last)
    options: dict[tuple[int, int], list] = {}
    bound = guess[0][state]
    while True:
        failed: dict[tuple[int, int], int] = {}
        beyond = NEVER
        path: list[str] = []
        stack = [(0, state, 0, 0)]  # place, state, cost, edits tried
        while stack:
            at, now, cost, tried = stack[-1]
            if tried == 0 and at == n:
                if cost + end[now] <= bound:
                    return "".join(path), cost, now
                beyond = min(beyond, cost + end[now])
            if (at, now) not in options:
                options[at, now] = moves(elements[at] if at < n else None, now) if at < n or last else []
            edits = options[at, now]
            if tried == len(edits):
                failed[at, now] = max(failed.get((at, now), -1), bound - cost)
                stack.pop()
                if path:
                    path.pop()
                continue
            stack[-1] = (at, now, cost, tried + 1)
            initials, price, done, to = edits[tried]
            place, total = at + done, cost + price
            least = total + guess[place][to]
            if least > bound:
                beyond = min(beyond, least)
            elif failed.get((place, to), -1) < bound - total:
                path.append(initials)
                stack.append((place, to, total, 0))
        bound = beyond


def edited(audit: str, rows: list[tuple[int, str, str]], state: int = START) -> list[tuple[str, str]]:
    """The repaired (role, text) of rows (run, role, text) under the edits."""
    out, place, left = [], 0, 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append((NAMES[state], ""))
            continue
        run, role, text = rows[place]
        left = left or max(run, 1)
        left -= 1
        if left == 0:
            place += 1
        if edit == "D":
            continue
        if edit == "K":
            state = ON[state][role[:1]]
        else:
            state = NEXT[state]
            role = NAMES[state]
        out.append((role, text))
    return out


# --- rows to pieces -------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by the crc32 of `conv_id:turn` modulo 20; nulls count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), way.alias("way")).filter("way <> 0")
    text = F.when(F.col("way") == 1, F.lit("")).when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("way") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("way") == 3, 2).otherwise(1).alias("copies"))


PIECE = (
    "conv_id long, piece long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "low long, high long, turns long, rows array<struct<run: long, role: string, text: string, truncated: boolean>>"
)
_ROWS = pa.list_(pa.struct([("run", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("truncated", pa.bool_())]))
_KINDS = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int64()] * 3 + [_ROWS]
_NAMES = [c.split()[0].strip() for c in PIECE.split("array<")[0].split(", ")]
#: Pieces that leave a task together.
GROUP = 64


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of rows (conv_id, turn, role, text, copies, fault) in order; faults: 0 none, 1 blank, 2 seen earlier, 3 truncated."""
    task, serial, out, piece, own = TaskContext.get().partitionId() << 32, 0, [], None, None

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], names=_NAMES)

    for batch in batches:
        for conv, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if piece is None or piece[0] != conv or own == SEGMENT:
                if piece is not None:
                    out.append(piece)
                if len(out) >= GROUP:
                    yield batch_of(out)
                    out = []
                serial += 1
                piece, own = [conv, task + serial, 0, 0, 0, 0, 0, role[:1], None, None, None, 0, []], 0
            own += 1
            if piece[8] is not None and piece[8] + role[:1] not in LEGAL:
                piece[6] += 1
            piece[6] += copies - 1  # no role may follow itself
            piece[2] += copies
            piece[3] += copies if fault == 1 else 0
            piece[4] += copies if fault == 2 else copies - 1 if fault != 1 else 0
            piece[5] += fault == 3
            piece[8] = role[:1]
            if turn is not None and turn != piece[10]:
                piece[9], piece[10], piece[11] = turn if piece[9] is None else piece[9], turn, piece[11] + 1
            rows = piece[12]
            stays = fault in (0, 3)
            if stays:
                rows.append({"run": 0, "role": role, "text": text, "truncated": fault == 3})
            if copies - stays:
                if rows and rows[-1]["run"]:
                    rows[-1]["run"] += copies - stays
                else:
                    rows.append({"run": copies - stays, "role": "", "text": "", "truncated": False})
    if piece is not None:
        out.append(piece)
    if out:
        yield batch_of(out)


def pieces(rows: DataFrame) -> DataFrame:
    """PIECEs of rows (conv_id, turn, role, text, copies), no nulls in role and text; `piece` rises with a conversation's order.

    Rows are ordered by turn (nulls first), role, text. Equal rows are one with a count.
    """
    key = ["conv_id", "role", "text"]
    counted = materialise(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "turns")
    turn: Column = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = counted.groupBy(*key).agg(F.min(turn).alias("earliest"), F.count("*").alias("n")).filter("n > 1").select(*(F.col(c).alias(f"_{c}") for c in key), "earliest")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))
    seen = F.col("earliest").isNotNull() & (F.col("earliest") != turn)
    fault = F.when(~F.col("text").rlike(f"[^{_WHITE}]"), 1).when(F.coalesce(seen, F.lit(False)), 2).when(~F.col("text").rlike(rf"[.!?][{_WHITE}]*\z"), 3).otherwise(0)
    faults = counted.join(again, same, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    return faults.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, PIECE)


# --- pieces to repaired conversations -----------------------------------------------


def _elements(rows: list[dict]) -> list[Element]:
    return [(r["run"], r["role"][:1], r["truncated"]) for r in rows]


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with audit, cost and the repaired turns instead of rows; beside them may stand `state`, `rest` and `final`."""
    for batch in batches:
        audits, costs, turns = [], [], []
        more = batch.num_columns > len(_NAMES)
        for i, rows in enumerate(batch.column(len(_NAMES) - 1)):
            rows = rows.as_py()
            state, rest, final = (batch.column(len(_NAMES) + k)[i].as_py() for k in range(3)) if more else (START, DONE, True)
            audit, cost, _ = search(_elements(rows), state, tuple(rest), final)
            audits.append(audit)
            costs.append(cost)
            turns.append([{"role": r, "text": t} for r, t in edited(audit, [(r["run"], r["role"], r["text"]) for r in rows], state)])
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(_NAMES) - 1], pa.array(audits, pa.string()), pa.array(costs, pa.int64()), pa.array(turns, kind)], names=[*_NAMES[:-1], "audit", "cost", "repaired"])


REPAIRED = PIECE.split(", rows")[0] + ", audit string, cost long, repaired array<struct<role: string, text: string>>"


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, piece, costs): a piece's least cost from each state to each, turns at its end not put in."""
    for batch in batches:
        out = []
        for rows in batch.column(2):
            elements = _elements(rows.as_py())
            out.append(list(chain.from_iterable(zip(*(rest_costs(elements, tuple(0 if s == to else NEVER for s in range(4)), False)[0] for to in range(4)), strict=True))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "piece", "costs"])


def _rests(group: pd.DataFrame) -> pd.DataFrame:
    """What the rest costs at the end of each piece of a conversation."""
    group = group.sort_values("piece")
    rest, out = list(rest_costs([], DONE, True)[0]), []
    for i, costs in enumerate(reversed(group["costs"].tolist())):
        out.append((list(DONE) if i == 0 else rest, i == 0))
        rest = [min(costs[4 * s + to] + rest[to] for to in range(4)) for s in range(4)]
    out.reverse()
    return pd.DataFrame({"conv_id": group["conv_id"], "piece": group["piece"], "rest": [r for r, _ in out], "final": [f for _, f in out]})


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, piece, ends): the state in which a piece's first cheapest path ends, for each state that it may begin in."""
    for batch in batches:
        out = []
        for rows, rest, final in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            elements = _elements(rows.as_py())
            out.append([search(elements, state, tuple(rest), final)[2] for state in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "piece", "ends"])


def _begins(group: pd.DataFrame) -> pd.DataFrame:
    """The state in which each piece of a conversation begins."""
    group = group.sort_values("piece")
    state, out = START, []
    for ends in group["ends"]:
        out.append(state)
        state = int(ends[state])
    return pd.DataFrame({"conv_id": group["conv_id"], "piece": group["piece"], "state": out})


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """REPAIRED pieces of conversations (conv_id, turn, role, text, copies): those of one piece, and those of several."""
    found = materialise(pieces(rows), "pieces", "zstd")
    several = found.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("_conv"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    single = found.join(several, same, "left_anti").mapInArrow(_repair, REPAIRED)
    long = materialise(found.join(several, same, "left_semi"), "long", "zstd")
    if long.isEmpty():
        return single, found.limit(0).mapInArrow(_repair, REPAIRED)
    both = lambda df: [F.col("conv_id").eqNullSafe(df["_conv"]), F.col("piece") == df["_piece"]]
    named = lambda df: df.withColumnsRenamed({"conv_id": "_conv", "piece": "_piece"})
    crossed = long.select("conv_id", "piece", "rows").mapInArrow(_crossings, "conv_id long, piece long, costs array<long>")
    rests = named(materialise(crossed.groupBy("conv_id").applyInPandas(_rests, "conv_id long, piece long, rest array<long>, final boolean"), "rests"))
    ended = long.join(rests, both(rests)).select("conv_id", "piece", "rows", "rest", "final").mapInArrow(_endings, "conv_id long, piece long, ends array<long>")
    begun = named(materialise(ended.groupBy("conv_id").applyInPandas(_begins, "conv_id long, piece long, state long"), "begins"))
    whole = long.join(begun, both(begun)).drop("_conv", "_piece").join(rests, both(rests))
    return single, whole.select(*long.columns, "state", "rest", "final").mapInArrow(_repair, REPAIRED)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of REPAIRED pieces in order; texts are hashed as they pass."""
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    now, done = None, []

    def finish() -> list:
        conv, blank, duplicate, truncated, illegal, cost, audit, digest, _, _, low, high, turns = now
        return [conv, 0 if low is None else high - low + 1 - turns, blank, duplicate, truncated, illegal, cost, "".join(audit), digest.hexdigest()]

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    for batch in batches:
        for i in range(batch.num_rows):
            conv, _, _, blank, duplicate, truncated, illegal, first, last, low, high, turns, audit, cost, repaired = (c[i].as_py() for c in batch.columns)
            if now is None or now[0] != conv:
                if now is not None:
                    done.append(finish())
                if len(done) >= 1024:
                    yield batch_of(done)
                    done = []
                now = [conv, 0, 0, 0, 0, 0, [], hashlib.sha256(), False, None, None, None, 0]
            for k, more in enumerate((blank, duplicate, truncated, illegal + (now[9] is not None and now[9] + first not in LEGAL), cost), 1):
                now[k] += more
            now[6].append(audit)
            now[9] = last
            if low is not None:
                now[12] += turns - (now[11] == low)
                now[10], now[11] = low if now[10] is None else now[10], high
            for turn in repaired:
                now[7].update((("\n" if now[8] else "") + turn["role"] + ":" + turn["text"]).encode())
                now[8] = True
    if now is not None:
        done.append(finish())
    if done:
        yield batch_of(done)


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summaries(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """SUMMARY for every conversation of `ids` (conv_id), a null one included; those without rows have zeros and an empty audit.

    rows: as damage() gives them. Rows of equal turn stand in the order of role and
    text. An empty table gives no rows; other columns than the named don't matter.
    """
    single, long = repair(rows)
    long = long.repartition("conv_id").sortWithinPartitions("conv_id", "piece")  # one hash of all of a conversation's text: in order, as it streams by
    found = single.mapInArrow(_summaries, SUMMARY).union(long.mapInArrow(_summaries, SUMMARY))
    found = found.withColumnRenamed("conv_id", "_conv")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
