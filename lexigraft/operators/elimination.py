"""Exact best assignments of many small documents at once, by variable elimination over NumPy arrays.

Documents of the same number of entities and the same pairs are solved together.
Entities are eliminated from the last to the first: what holds for one, given those
before it that it is tied to, becomes a table over these. Chains and trees whose ties
go back to one earlier entity have tables of one dimension, so their cost is linear.
Assigned from the first to the last, each entity takes the first of equal choices, so
of equal scores the smallest choices in order win.
"""

from __future__ import annotations

import numpy as np

#: The score of what isn't possible; cells of a table for a document at most.
IMPOSSIBLE, CELLS = -(1 << 50), 4_096


def scopes(n: int, pairs: tuple[tuple[int, int], ...]) -> list[tuple[int, ...]]:
    """For each entity the earlier ones that its table depends on."""
    tied: list[set[int]] = [set() for _ in range(n)]
    for a, b in pairs:
        if a != b:
            tied[max(a, b)].add(min(a, b))
    for v in range(n - 1, -1, -1):
        if tied[v]:
            tied[max(tied[v])] |= tied[v] - {max(tied[v])}
    return [tuple(sorted(t)) for t in tied]


def fits(n: int, pairs: tuple[tuple[int, int], ...], choices: int) -> bool:
    return all(choices ** (len(s) + 1) <= CELLS for s in scopes(n, pairs))


def solve(single: np.ndarray, pairs: tuple[tuple[int, int], ...], double: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores (docs,) and choices (docs, n) of the best assignments; a score below half of IMPOSSIBLE means that there is none.

    single (docs, n, choices) are entities' scores and double (docs, pairs, choices, choices) those of pairs, first entity first.
    """
    docs, n, t = single.shape
    scope = scopes(n, pairs)
    held: list[list[tuple[tuple[int, ...], np.ndarray]]] = [[((v,), single[:, v])] for v in range(n)]
    constant = np.zeros(docs, np.int64)
    for k, (a, b) in enumerate(pairs):
        if a == b:
            held[a].append(((a,), np.diagonal(double[:, k], axis1=1, axis2=2)))
        else:
            held[max(a, b)].append(((a, b), double[:, k]) if a < b else ((b, a), double[:, k].transpose(0, 2, 1)))
    picks: list[np.ndarray] = [np.zeros(0)] * n
    for v in range(n - 1, -1, -1):
        own = (*scope[v], v)
        table = np.zeros((docs, *[t] * len(own)), np.int64)
        for names, values in held[v]:
            table += values.reshape(docs, *(t if x in names else 1 for x in own))
        np.maximum(table, IMPOSSIBLE, out=table)
        picks[v] = table.argmax(axis=-1)
        most = table.max(axis=-1)
        if scope[v]:
            held[scope[v][-1]].append((scope[v], most))
        else:
            constant = np.maximum(constant + most, IMPOSSIBLE)
    out = np.zeros((docs, n), np.int64)
    rows = np.arange(docs)
    for v in range(n):
        out[:, v] = picks[v][(rows, *(out[:, s] for s in scope[v]))]
    return constant, out
