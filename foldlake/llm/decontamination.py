"""Benchmark passages inside documents, by q-gram filtering and banded alignment.

Texts are normalised (ASCII lower case, other than letters and digits one space).  An item of
m bytes may be met with up to e(m) edits.  By the q-gram lemma an occurrence keeps at least
m + 1 - q (e + 1) of the item's q-grams, on diagonals that differ by at most e.  So, for each
document and item, shared q-grams are counted in overlapping bands of diagonals as wide as
the item's own budget asks, bands below the bound are dropped, and the rest is verified by an
alignment restricted to the band, which gives every end where the item is met.

Places.  A match is (edits, start, end) with the fewest edits, then the smallest start, for
its end.  The places of an item in a text are its matches taken in that order, but for those
that overlap one taken before; so each of several copies is a place of its own, and the
places of one item do not depend on the others.

Documents stay where they are: the job is a narrow map over whole texts.  The benchmark's
q-gram index is broadcast in parts of at most ``PART_BYTES`` of text (or one longer item).
With several parts each is a pass of its own over the texts that leaves only the texts that
leak, under a hash of 128 bits; its index is given up before the next part is read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from . import words as W
from .shared import checkpointed, fields, left_join_unique, mapped, whole

Q = 10
EDIT_RATE = 0.08
PART_BYTES = 8 << 20
_FILTER_BITS = 22
#: Shared q-grams that are looked at together; more are met in smaller pieces of text.
TOGETHER = 1 << 22

_SAME = np.full(256, 32, dtype=np.uint8)
for _b in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _SAME[_b] = _b
_SAME[65:91] = np.arange(97, 123, dtype=np.uint8)

LEAK = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])


def edit_budget(m: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """The edits allowed for an item of ``m`` bytes: ``rate`` of it, as long as the lemma asks for a shared q-gram."""
    return max(0, min(int(rate * m), (m - q) // q))


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal bytes of rows, the byte each came from, and offsets of the rows; no row begins with a space."""
    low = _SAME[data]
    space = low == 32
    before = np.empty_like(space)
    before[:1] = True
    before[1:] = space[:-1]
    before[offsets[offsets < len(data)]] = True
    kept = np.flatnonzero(~(space & before))
    return low[kept], kept, np.searchsorted(kept, offsets)


@dataclass
class Index:
    ids: list[int]
    items: list[np.ndarray]
    budgets: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    filter: np.ndarray
    q: int


def build(rows: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE) -> Index:
    """The q-gram index of (item id, text); items of fewer than ``q`` normal bytes hold no q-gram and are left out."""
    ids, items, hashes, item, at = [], [], [], [], []
    for item_id, text in rows:
        data, offsets = W.buffers(pa.array([text]))
        low = normalised(data, offsets)[0]
        low = low[:-1] if len(low) and low[-1] == 32 else low
        if len(low) < q:
            continue
        hashes.append(W.window_hashes(low, q))
        item.append(np.full(len(hashes[-1]), len(items)))
        at.append(np.arange(len(hashes[-1])))
        ids.append(item_id)
        items.append(low)
    h, item, at = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((hashes, np.uint64), (item, np.int64), (at, np.int64)))
    order = np.argsort(h, kind="stable")
    unique, first = np.unique(h[order], return_index=True)
    m = np.array([len(x) for x in items], dtype=np.int64)
    e = np.array([edit_budget(int(x), q, rate) for x in m], dtype=np.int64)
    passes = np.zeros(1 << _FILTER_BITS, dtype=bool)
    passes[unique >> np.uint64(64 - _FILTER_BITS)] = True
    return Index(ids, items, e, np.maximum(1, m + 1 - q * (e + 1)), unique, np.append(first, len(h)), item[order], at[order], passes, q)


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, starts, ends) of the best match of the whole item for each end in ``text``, on diagonals low..high.

    Row by row over the item; a cell holds its edits and, below them, where its path began.
    """
    width = high - low + 1
    k = np.arange(width, dtype=np.int64)
    step = np.int64(1) << 40
    none = step * (len(item) + width + 2)
    begin = low + k
    cells = np.where((begin >= 0) & (begin <= len(text)), np.clip(begin, 0, len(text)), none)
    # row i reads the bytes from low + i on; those before and behind the text are none
    lo, hi = max(0, low), min(len(text), high + len(item))
    padded = np.zeros(width + len(item), np.uint8)
    inside = np.zeros(width + len(item), bool)
    if lo < hi:
        padded[lo - low : hi - low], inside[lo - low : hi - low] = text[lo:hi], True
    for i, byte in enumerate(item):
        own, real = padded[i : i + width], inside[i : i + width]
        kept = np.where(real, cells + step * (own != byte), none)
        skip = np.append(cells[1:], none) + step
        best = np.minimum(kept, skip)
        best = np.minimum.accumulate(best - k * step) + k * step
        cells = np.minimum(np.where(real, best, np.minimum(best, skip)), none)
    return cells >> 40, cells & (step - 1), low + k + len(item)


def places(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The (edits, start, end) that stay: in sorted order, but for those that overlap one that stays."""
    starts, ends, out = [], [], []
    for edits, start, end in sorted(matches):
        k = bisect.bisect_left(starts, end)
        if k == 0 or ends[k - 1] <= start:
            starts.insert(k, start)
            ends.insert(k, end)
            out.append((edits, start, end))
    return out


def _shared(low: np.ndarray, offsets: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, rows, first entry, entries) of the q-grams of the texts that the benchmark has."""
    h = W.window_hashes(low, index.q)
    starts = np.flatnonzero(index.filter[h >> np.uint64(64 - _FILTER_BITS)])
    row = np.searchsorted(offsets, starts, side="right") - 1
    ok = starts + index.q <= offsets[row + 1]
    starts, row = starts[ok], row[ok]
    place = np.searchsorted(index.hashes, h[starts])
    ok = index.hashes[np.minimum(place, len(index.hashes) - 1)] == h[starts]
    starts, row, place = starts[ok], row[ok], place[ok]
    return starts, row, index.first[place], index.first[place + 1] - index.first[place]


def _matches(low: np.ndarray, offsets: np.ndarray, index: Index) -> dict[tuple[int, int], dict[int, tuple[int, int]]]:
    """For each (row, item) that meets its budget: (edits, start) of each end, in normal bytes of the row."""
    q, n = index.q, len(index.items)
    out: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
    if not n or len(low) < q:
        return out
    # of a cut text both parts see what lies within four lengths of an item, so neighbours of a match are known
    reach = 4 * max(len(x) for x in index.items) + 64
    long = len(low) > max(4 * reach, 2 * W.SLICE_BYTES)
    starts, row, first, count = _shared(low, offsets, index) if not long else (np.zeros(0, np.int64),) * 4
    if long or count.sum() > TOGETHER and (len(offsets) > 2 or len(low) > 4 * reach):
        if len(offsets) > 2:
            half = (len(offsets) - 1) // 2
            cuts = [(0, half, 0, int(offsets[half])), (half, len(offsets) - 1, int(offsets[half]), int(offsets[-1]))]
            for a, b, x, y in cuts:
                for (r, i), own in _matches(low[x:y], offsets[a : b + 1] - x, index).items():
                    out[r + a, i] = own
            return out
        half = len(low) // 2  # every match lies wholly in the first part, or begins in the second
        for x, y in ((0, min(len(low), half + reach)), (half, len(low))):
            for key, own in _matches(low[x:y], np.array([0, y - x]), index).items():
                kept = out.setdefault(key, {})
                for end, (edits, start) in own.items():
                    kept[end + x] = min(kept.get(end + x, (1 << 40, 0)), (edits, start + x))
        return out
    source = np.repeat(np.arange(len(starts)), count)
    entry = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count) + first[source]
    item, row = index.item[entry], row[source]
    diagonal = starts[source] - offsets[row] - index.at[entry]
    band = diagonal // (index.budgets[item] + 1)
    span = int(band.max() - band.min()) + 3 if len(band) else 1
    base = int(band.min()) - 1 if len(band) else 0
    keys = np.concatenate([(row * n + item) * span + band - base - shift for shift in (0, 1)])
    where = np.concatenate([diagonal, diagonal])
    at = np.concatenate([index.at[entry]] * 2)
    unique, inverse = np.unique(keys, return_inverse=True)
    # each q-gram of the item counts once in a band, however often the text repeats it
    longest = max(len(x) for x in index.items)
    once = np.unique(inverse * longest + at) // longest
    hits = np.bincount(once, minlength=len(unique))
    good = hits >= index.bounds[unique // span % n]
    order = np.argsort(inverse, kind="stable")
    ends = np.cumsum(np.bincount(inverse, minlength=len(unique)))
    found = []
    exact: dict[tuple[int, int], set[int]] = {}
    for k in np.flatnonzero(good):
        r, i = divmod(int(unique[k]) // span, n)
        text, m = low[offsets[r] : offsets[r + 1]], len(index.items[i])
        own, several = np.unique(where[order[ends[k - 1] if k else 0 : ends[k]]], return_counts=True)
        same = {int(d) for d in own[several == m - q + 1] if d >= 0 and np.array_equal(text[d : d + m], index.items[i])}
        found.append((r, i, int(own[0]), int(own[-1]), same))
        exact.setdefault((r, i), set()).update(same)
    for r, i, lowest, highest, same in found:
        text, m, e = low[offsets[r] : offsets[r + 1]], len(index.items[i]), int(index.budgets[i])
        kept = out.setdefault((r, i), {})
        d = min(same) if len(same) == 1 else None
        if d is not None and not any(0 < abs(x - d) < 2 * m for x in exact[r, i]):
            # an exact copy with no other near it is a place, and all else in its band overlaps it
            kept[d + m] = (0, d)
            continue
        edits, begins, stops = banded(index.items[i], text, lowest - e, highest + e)
        for j in np.flatnonzero((edits <= e) & (stops > begins)):
            end = int(stops[j])
            kept[end] = min(kept.get(end, (1 << 40, 0)), (int(edits[j]), int(begins[j])))
    return out


def _found(low: np.ndarray, offsets: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end) of all places, in normal bytes of the row, by row and item."""
    matches = _matches(low, offsets, index)
    return [(r, i, *p) for r, i in sorted(matches) for p in places([(edits, start, end) for end, (edits, start) in matches[r, i].items()])]


def _leaks(column: pa.Array, index: Index) -> list[list[dict]]:
    data, offsets = W.buffers(column)
    out: list[list[dict]] = [[] for _ in range(len(column))]
    for lo, hi in W.slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        low, kept, at = normalised(part, offsets[lo : hi + 1] - offsets[lo])
        found = _found(low, at, index)
        if not found:
            continue
        chars = np.zeros(len(part) + 1, dtype=np.int64)
        np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
        for r, i, edits, start, end in found:
            origin, last = int(offsets[lo + r] - offsets[lo]), int(offsets[lo + r + 1] - offsets[lo])
            a, b = int(kept[at[r] + start]), int(kept[at[r] + end - 1]) + 1
            while b < last and part[b] & 0xC0 == 0x80:
                b += 1
            out[lo + r].append({"item_id": index.ids[i], "start": int(chars[a] - chars[origin]), "end": int(chars[b] - chars[origin]), "edits": edits})
    for own in out:
        own.sort(key=lambda x: (x["start"], x["end"], x["item_id"]))
    return out


def _parts(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in order, in parts of at most ``most`` bytes (or one longer item); the driver holds one at a time."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in items.orderBy("item_id", "text").toLocalIterator():
        own = len(r["text"].encode())
        if held and size + own > most:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += own
    yield held


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc, leaks): each row as a struct, and the places of items in its text."""
    spark = docs.sparkSession
    items = benchmark.where(F.col("item_id").isNotNull() & (F.octet_length("text") >= q)).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    kind = from_arrow_type(pa.list_(LEAK))

    def searched(texts: DataFrame, rows: list[tuple[int, str]]) -> tuple[DataFrame, object]:
        shared = spark.sparkContext.broadcast(build(rows, q, rate))
        return mapped(texts, lambda text: [pa.array(_leaks(text, shared.value), pa.list_(LEAK))], leaks=kind), shared

    if total <= part_bytes:
        return searched(docs, sorted((r["item_id"], r["text"]) for r in items.collect()))[0]
    key = lambda text: F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    leaky = None
    for rows in _parts(items, part_bytes):
        out, shared = searched(docs.select("text"), rows)
        out = out.where(F.size("leaks") > 0).select(key(F.col("doc.text")).alias("_key"), "leaks").groupBy("_key").agg(F.first("leaks").alias("leaks"), F.count("*").alias("_n"))
        out = checkpointed(out)
        shared.destroy()
        leaky = out if leaky is None else leaky.union(out)
    leaky = leaky.groupBy("_key").agg(F.flatten(F.collect_list("leaks")).alias("leaks"), F.max("_n").alias("_n"))
    order = F.transform(F.array_sort(F.transform("leaks", lambda x: F.struct(x["start"], x["end"], x["item_id"], x["edits"]))), lambda x: F.struct(x["item_id"].alias("item_id"), x["start"].alias("start"), x["end"].alias("end"), x["edits"].alias("edits")))
    leaky = leaky.select("_key", order.alias("leaks"), "_n")
    keyed = docs.select(whole(docs), key(F.col("text")).alias("_key"))
    out = left_join_unique(keyed, leaky, "_key", "_n", max(1, docs.count()))
    return out.select("doc", F.coalesce("leaks", F.array().cast(kind)).alias("leaks"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with leaks: array of (item_id, start, end, edits), code points of the original text, end exclusive.

    A null text holds no leak.  Items whose id or text is null, or of fewer than ``q`` normal
    bytes, are never met; equal items are each reported, and so is each place of an item, in
    the order of start, end and item_id.  An empty benchmark gives empty arrays.  Rows are
    decided alone, so repeated rows agree.  A column leaks of the input is replaced; all
    others keep their names and values.
    """
    return leaks(docs, benchmark, q, rate, part_bytes).select(*fields(docs, without=("leaks",)), "leaks")
