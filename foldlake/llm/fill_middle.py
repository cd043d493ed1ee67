"""Fill-in-the-middle rearrangement, cut by a table-driven automaton over bytes.

One automaton reads UTF-8: its state holds how many continuation bytes are due and how much
of a sentinel has been seen.  A transition tells whether its byte begins a unit (a code point)
and whether it completes a sentinel.

1. The scan.  Rows are cut into lanes of ``LANE`` bytes that are read in step, one table
   lookup a byte.  The state depends on the last few bytes only, so a lane begins that many
   bytes early and needs no other lane.  What is emitted is counted: units and sentinels of
   each lane.
2. The cuts.  A hash of the id gives the units before a cut.  The lane counts say which lane
   holds it, and only these lanes are read again, to the byte.

Lanes are read in groups of ``GROUP``, so memory follows the text itself and never a copy for
each position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import words as W
from .shared import fields

# The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PERCENT, SPM_PERCENT = 90, 20
LANE, GROUP = 64, 8192
SLICE = 8 << 20
#: The symbol beyond a row's ends, after the 256 bytes.
END = 256


class Automaton:
    """The transitions of one set of sentinels: ``next``, ``unit`` and ``hit`` by state * 257 + symbol, and the ``memory`` in bytes."""

    def __init__(self, sentinels: tuple[str, ...]):
        words = [s.encode() for s in sentinels]
        begun = sorted({w[:k] for w in words for k in range(len(w))})
        self.memory = max(3, *(len(w) - 1 for w in words))
        states = {(b"", 0): 0}
        todo, rows = [(b"", 0)], []
        while todo:
            seen, due = todo.pop(0)
            row = []
            for symbol in range(257):
                text = seen + bytes([symbol]) if symbol < END else b""
                hit = any(text.endswith(w) for w in words)
                while text not in begun:
                    text = text[1:]
                tail = 0x80 <= symbol < 0xC0
                left = max(due - 1, 0) if tail else (symbol >= 0xC0) + (symbol >= 0xE0) + (symbol >= 0xF0) if symbol < END else 0
                state = (text, left)
                if state not in states:
                    states[state] = len(states)
                    todo.append(state)
                row.append((states[state], symbol < END and not tail, hit))
            rows.append(row)
        flat = np.array([x for row in rows for x in row])
        self.next = (flat[:, 0] * 257).astype(np.int32)
        self.unit = flat[:, 1].astype(np.int32)
        self.hit = flat[:, 2].astype(bool)


AUTOMATON = Automaton((PREFIX, SUFFIX, MIDDLE))


def _symbols(data: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray, memory: int) -> np.ndarray:
    """For each lane the symbols of its bytes and of those before them, one lane a column; END outside its row lo..hi."""
    width = memory + LANE
    begin, stop = int(first.min()) - memory, int(first.max()) + LANE
    part = np.zeros(stop - begin, dtype=np.uint8)
    a, b = max(begin, 0), min(stop, len(data))
    part[a - begin : b - begin] = data[a:b]
    lanes = np.lib.stride_tricks.sliding_window_view(part, width)[first - memory - begin].T.astype(np.int32)
    at = first - memory + np.arange(width)[:, None]
    lanes[(at < lo) | (at >= hi)] = END
    return lanes


class Lanes:
    """The lanes of rows of bytes, with the units in each: the result of the scan, and where the cuts are looked up."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, automaton: Automaton = AUTOMATON):
        self.data, self.automaton = data, automaton
        n = -(-np.diff(offsets) // LANE)
        self.begin = np.concatenate([[0], np.cumsum(n)])
        row = np.repeat(np.arange(len(n)), n)
        self.first = offsets[:-1][row] + LANE * (np.arange(self.begin[-1]) - self.begin[:-1][row])
        self.lo, self.hi = offsets[:-1][row], offsets[1:][row]
        units, hits = np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=bool)
        for g in range(0, len(row), GROUP):
            own = slice(g, g + GROUP)
            for step, at in self._read(own):
                if step >= 0:
                    units[own] += automaton.unit[at]
                    hits[own] |= automaton.hit[at]
        self.after = np.concatenate([[0], np.cumsum(units)])
        #: units of each row, and whether it holds a sentinel
        self.units = self.after[self.begin[1:]] - self.after[self.begin[:-1]]
        self.marked = np.diff(np.concatenate([[0], np.cumsum(hits)])[self.begin]) > 0

    def _read(self, own: slice | np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The transition of each lane at each step; steps before a lane's own bytes are negative."""
        a = self.automaton
        state = np.zeros(len(self.first[own]), dtype=np.int32)
        for k, symbol in enumerate(_symbols(self.data, self.first[own], self.lo[own], self.hi[own], a.memory)):
            at = state + symbol
            state = a.next[at]
            yield k - a.memory, at

    def cuts(self, rows: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The byte in ``data`` before which row rows[k] has units[k] whole units (fewer than it has)."""
        wanted = self.after[self.begin[rows]] + units
        lane = np.searchsorted(self.after, wanted, side="right") - 1
        out = np.zeros(len(rows), dtype=np.int64)
        # lanes in the order of the text, so that a group reads one stretch of it
        order = np.argsort(lane, kind="stable")
        for g in range(0, len(rows), GROUP):
            own = order[g : g + GROUP]
            left = wanted[own] - self.after[lane[own]]
            for step, at in self._read(lane[own]):
                if step >= 0:
                    unit = self.automaton.unit[at]
                    out[own[(unit == 1) & (left == 0)]] = self.first[lane[own[(unit == 1) & (left == 0)]]] + step
                    left = left - unit
        return out


def _cut(percent: int, spm: int):
    """(doc, text, h1..h4) to (doc, n, form, prefix_chars, middle_chars, output)."""
    marks = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffers(batch.column(1))
            h = [batch.column(k).to_numpy() for k in range(2, 6)]
            for lo, hi in W.slices(offsets, SLICE):
                part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                lanes = Lanes(part, at)
                n = lanes.units
                h1, h2, h3, h4 = (x[lo:hi] for x in h)
                plain = (n == 0) | lanes.marked | (h3 % 100 >= percent)
                points = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
                ends = np.stack([at[1:], at[1:]])  # a cut behind the last unit
                for k in (0, 1):
                    inner = np.flatnonzero(~plain & (points[k] < n))
                    ends[k, inner] = lanes.cuts(inner, points[k, inner])
                form = np.where(plain, "plain", np.where(h4 % 100 < spm, "spm", "psm"))
                whole, out = memoryview(part), []
                for r in range(hi - lo):
                    if plain[r]:
                        out.append(bytes(whole[at[r] : at[r + 1]]))
                        continue
                    prefix, middle, suffix = whole[at[r] : ends[0, r]], whole[ends[0, r] : ends[1, r]], whole[ends[1, r] : at[r + 1]]
                    pairs = [(marks[0], prefix), (marks[1], suffix)]
                    out.append(b"".join([x for pair in (pairs if form[r] == "psm" else pairs[::-1]) for x in pair] + [marks[2], middle]))
                numbers = [pa.array(x, pa.int64(), mask=plain) for x in (points[0], points[1] - points[0])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(form.tolist(), pa.string()), *numbers, pa.array(out, pa.binary()).view(pa.string())], ["doc", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def _coins(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED, id_col: str = "doc_id", carried: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output: each text cut in three and rearranged.

    n counts code points.  Form is plain (the text as it is) for empty texts, those that hold a
    sentinel, and all but ``percent`` of the rest; ``spm_percent`` of the others put the suffix
    first.  A null text is an empty one, a null id the empty one.  Every row is cut alone, so
    repeated rows come out alike.  ``carried`` names the columns to keep (all, if None); those
    of the five names are replaced.
    """
    names = docs.columns if carried is None else list(carried)
    own = StructType([docs.schema[c] for c in names])
    doc = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
    added = StructType([StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])
    schema = StructType([StructField("doc", own), *added])
    out = docs.select(doc, "text", *_coins(F.col(f"`{id_col}`"), seed)).mapInArrow(_cut(percent, spm_percent), schema)
    return out.select(*fields(docs.select(*[F.col(f"`{c}`") for c in names]), without=tuple(added.names)), *added.names)


def restored(output: Column, form: Column) -> Column:
    """The text out of its rearranged form: the sentinels split it, and the form orders the parts."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    piece = lambda k: F.element_at(part, k)
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece(2), piece(4), piece(3))).otherwise(F.concat(piece(3), piece(4), piece(2)))
