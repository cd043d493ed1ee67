"""Matching the points of two chains in order, for many pairs of chains in step.

The cells of an anti-diagonal depend on the two before it only, so values take three diagonals
whatever the lengths, and what a match gains is computed as a diagonal is reached.  Of each cell
one byte is kept, which way it came.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Gain = Callable[[int, int, int], np.ndarray]
#: Bytes of ways that are held at once.
HELD = 64 << 20


def by_distance(x: np.ndarray, y: np.ndarray, scale: np.ndarray, same: Gain | None = None, bonus: float = 0.0) -> Gain:
    """1 / (1 + d2 / scale2), and ``bonus`` where ``same`` is 1."""
    planes = np.ascontiguousarray((x / scale[:, None, None]).transpose(2, 0, 1))
    other = np.ascontiguousarray((y / scale[:, None, None])[:, ::-1].transpose(2, 0, 1))
    m = y.shape[1]

    def gain(lo: int, hi: int, d: int) -> np.ndarray:
        off = planes[:, :, lo - 1 : hi] - other[:, :, m - d + lo : m - d + hi + 1]
        off *= off
        sums = off[0] + off[1]
        sums += off[2]
        sums += 1
        np.reciprocal(sums, out=sums)
        return sums if same is None else sums + bonus * same(lo, hi, d)

    return gain


def by_kind(x: np.ndarray, y: np.ndarray) -> Gain:
    """1 where two codes are equal."""
    other, m = np.ascontiguousarray(y[:, ::-1]), y.shape[1]
    return lambda lo, hi, d: (x[:, lo - 1 : hi] == other[:, m - d + lo : m - d + hi + 1]).astype(float)


def by_table(table: np.ndarray) -> Gain:
    """The values of tables (s, n, m) given in full."""

    def gain(lo: int, hi: int, d: int) -> np.ndarray:
        i = np.arange(lo, hi + 1)
        return table[:, i - 1, d - i - 1]

    return gain


def matched(gain: Gain, rows: np.ndarray, columns: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """(s, m): for each column of each pair the row that it is matched with, or -1.

    Leaving a match costs ``opening``, going on is free, and so are gaps before the first
    match; ties prefer the match, then the step along the columns.
    """
    s, n, m = len(rows), int(rows.max(initial=0)), int(columns.max(initial=0))
    cost = np.asarray(opening, dtype=float).reshape(-1, 1)
    before, last, now = (np.zeros((s, n + 1)) for _ in range(3))
    held, held_now = (np.zeros((s, n + 1)) for _ in range(2))
    ways = np.zeros((n + m + 1, s, n + 1), dtype=np.uint8)
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        here, there = slice(lo, hi + 1), slice(lo - 1, hi)
        leave = held * cost
        leave += last
        up, left = leave[:, there], leave[:, here]
        hit = before[:, there] + gain(lo, hi, d)
        other = np.maximum(up, left)
        match = hit >= other
        np.maximum(hit, other, out=now[:, here])
        held_now[:, here] = match
        ways[d, :, here] = match | ((left >= up) << 1)
        before, last, now = last, now, before
        held, held_now = held_now, held
    out = np.full((s, m), -1)
    i, j, own = rows.astype(np.int64).copy(), columns.astype(np.int64).copy(), np.arange(s)
    while len(own := own[(i[own] > 0) & (j[own] > 0)]):
        way = ways[i[own] + j[own], own, i[own]]
        hit = way & 1 == 1
        out[own[hit], j[own[hit]] - 1] = i[own[hit]] - 1
        i[own] -= hit | (way == 0)
        j[own] -= hit | (way == 2)
    return out


def at_once(n: int, m: int) -> int:
    """How many pairs of chains of n and m points are matched together."""
    return max(1, HELD // ((n + m + 1) * (n + 1)))
