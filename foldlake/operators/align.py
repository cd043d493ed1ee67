"""Alignment and circular permutation of pairs of chains.

Pairs are rows.  Spark deals them out by the cells of their matrices, ``aligned`` adds the
alignment of one query column with one target column, and everything told about an alignment
(``path``, ``fitted``, ``brought``) is expressions over its rotation and shift.  A permuted
alignment is three such columns: in order, with the query doubled, and with the query turned.

Inside a task all pairs of a batch move in step: their seeds, the matching of each seed, and the
search for the superposition of the best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as G
from . import superpose as S
from .paths import at_once, by_distance, by_kind, matched
from .superpose import final_scale, fit, rmsd, score_cutoff, search_scale  # noqa: F401

OPENINGS = (-0.6, 0.0)
#: Largest step between neighbours of an unbroken fragment.
UNBROKEN = 4.25
#: Cells (points of one chain times points of the other) of one task.
TASK_CELLS = 2_000_000
#: Problems of a pair that are matched in step: its seeds with each opening.
PROBLEMS = 8
#: How far, in parts of its scale, points may be apart that a score counts in full (to 12 digits).
MEETS = 1e-6
COARSE, SEEDS = 40, ("thread", "kinds", "local", "fragment")


def kinds(x: np.ndarray) -> np.ndarray:
    """Codes of secondary structure (0 C, 1 T, 2 E, 3 H) by the rule of ``geometry.secondary_structure``."""
    out = np.zeros(len(x), dtype=np.uint8)
    if len(x) < 5:
        return out
    gap = lambda a, b: np.linalg.norm(x[2 + a : len(x) - 2 + a] - x[2 + b : len(x) - 2 + b], axis=1)
    six = np.stack([gap(*ab) for ab in ((-2, 0), (-2, 1), (-2, 2), (-1, 1), (-1, 2), (0, 2))])
    like = lambda ideal, most: (np.abs(six - np.array(ideal)[:, None]) < most).all(axis=0)
    out[2:-2] = np.select([like(G.HELIX, G.HELIX_WITHIN), like(G.STRAND, G.STRAND_WITHIN), six[2] < G.TURN], [3, 2, 1], 0)
    return out


@dataclass
class Block:
    """Pairs of chains padded to one size: points (b, n, 3) and (b, m, 3), their kinds and their lengths."""

    x: np.ndarray
    y: np.ndarray
    kx: np.ndarray
    ky: np.ndarray
    n: np.ndarray
    m: np.ndarray

    @classmethod
    def of(cls, pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Block:
        def padded(parts: list[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(parts), max(map(len, parts)), *parts[0].shape[1:]), dtype=parts[0].dtype)
            for row, part in zip(out, parts, strict=True):
                row[: len(part)] = part
            return out

        x, y, kx, ky = (list(p) for p in zip(*pairs, strict=True))
        return cls(padded(x), padded(y), padded(kx), padded(ky), np.array([len(p) for p in x]), np.array([len(p) for p in y]))

    def __post_init__(self):
        short = np.minimum(self.n, self.m)
        self.short = short
        self.scale = np.array([search_scale(int(k)) for k in short])
        self.cap = np.array([score_cutoff(int(k)) for k in short])

    def part(self, rows: np.ndarray) -> Block:
        """Some of the pairs, at the size of the longest of them."""
        n, m = (int(side[rows].max(initial=0)) for side in (self.n, self.m))
        return Block(self.x[rows, :n], self.y[rows, :m], self.kx[rows, :n], self.ky[rows, :m], self.n[rows], self.m[rows])

    def paired(self, owner: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The matched points of each row, side by side at the front, and how many there are."""
        count = (match >= 0).sum(axis=1)
        column = np.argsort(match < 0, axis=1, kind="stable")[:, : max(int(count.max(initial=0)), 1)]
        row = np.maximum(np.take_along_axis(match, column, axis=1), 0)
        return self.x[owner[:, None], row], self.y[owner[:, None], column], count

    def fast(self, owner: np.ndarray, match: np.ndarray) -> np.ndarray:
        """Fast scores of matches (s, m), in groups that fit in memory."""
        out, each = np.empty(len(owner)), max(1, S.TOGETHER // self.y.shape[1])
        for k in range(0, len(owner), each):
            x, y, count = self.paired(owner[k : k + each], match[k : k + each])
            out[k : k + each] = S.fast_score(x, y, np.arange(x.shape[1]) < count[:, None], self.scale[owner[k : k + each]])
        return out

    def match(self, owner: np.ndarray, r: np.ndarray, t: np.ndarray, scale: np.ndarray, opening: np.ndarray, bonus: float = 0.0) -> np.ndarray:
        """Matches by distance after each row's superposition, with ``bonus`` for equal kinds."""
        out = np.full((len(owner), self.y.shape[1]), -1)
        each = at_once(self.x.shape[1], self.y.shape[1])
        for k in range(0, len(owner), each):
            o, own = owner[k : k + each], slice(k, k + each)
            same = by_kind(self.kx[o], self.ky[o]) if bonus else None
            found = matched(by_distance(S.moved(self.x[o], r[own], t[own]), self.y[o], scale[own], same, bonus), self.n[o], self.m[o], opening[own])
            # as wide as the longest target of the group
            out[own, : found.shape[1]] = found
        return out


def _first_best(owner: np.ndarray, score: np.ndarray, last: bool = False) -> np.ndarray:
    """One row of each owner (ascending): its best, the first (or ``last``) of equals."""
    place = np.arange(len(owner))
    order = np.lexsort((-place if last else place, -score, owner))
    return order[np.append(True, owner[order][1:] != owner[order][:-1])] if len(order) else order


def _chosen(block: Block, rows: list[tuple[int, np.ndarray]], last: bool) -> np.ndarray:
    """(b, m): of candidate matches (owner, match) the one of the best fast score; -1 throughout where a pair has none."""
    out = np.full((len(block.n), block.y.shape[1]), -1)
    if rows:
        owner, match = np.array([o for o, _ in rows]), np.stack([m for _, m in rows])
        for k in _first_best(owner, block.fast(owner, match), last):
            out[owner[k]] = match[k]
    return out


def thread(block: Block, step: int = 1) -> np.ndarray:
    """Seed: the whole chains against each other without gaps, half of the shorter one at least."""
    j, rows = np.arange(block.y.shape[1]), []
    for b, (n, m) in enumerate(zip(block.n, block.m, strict=True)):
        least = min(max(min(n, m) // 2, 5), min(n, m))
        for k in range(least - m, n - least + 1, step):
            rows.append((b, np.where((j < m) & (j + k >= 0) & (j + k < n), j + k, -1)))
    return _chosen(block, rows, True)


def like_kinds(block: Block) -> np.ndarray:
    """Seed: secondary structure against secondary structure."""
    return matched(by_kind(block.kx, block.ky), block.n, block.m, np.full(len(block.n), -1.0))


def _jump(n: int) -> int:
    return max(1, min(45 if n > 250 else 35 if n > 200 else 25 if n > 150 else 15, n // 3))


def local(block: Block, spread: int = 1) -> np.ndarray:
    """Seed: fragments of two sizes fitted on fragments, each matched over the whole chains."""
    out = []
    for b, (n, m) in enumerate(zip(block.n, block.m, strict=True)):
        short = min(n, m)
        for size in (min(20, short // 3), min(100, short // 2)):
            if size >= 3:
                out += [(b, i, j, size) for i in range(0, n - size + 1, _jump(n) * spread) for j in range(0, m - size + 1, _jump(m) * spread)]
    best = np.full((len(block.n), block.y.shape[1]), -1)
    score = np.zeros(len(block.n))
    each = at_once(block.x.shape[1], block.y.shape[1])
    for k in range(0, len(out), each):
        owner, i, j, size = (np.array(c) for c in zip(*out[k : k + each], strict=True))
        place = np.arange(size.max())
        chosen = place < size[:, None]
        at = lambda first, n: np.minimum(first[:, None] + place, n[owner, None] - 1)
        r, t = fit(block.x[owner[:, None], at(i, block.n)], block.y[owner[:, None], at(j, block.m)], chosen)
        match = block.match(owner, r, t, block.scale[owner] + 1.5, np.zeros(len(owner)))
        found = block.fast(owner, match)
        for row in _first_best(owner, found):
            if found[row] > score[owner[row]]:
                score[owner[row]], best[owner[row]] = found[row], match[row]
    return best


def unbroken(x: np.ndarray, least: int) -> tuple[int, int]:
    """First and last place of the longest run of near neighbours; the limit grows by a tenth until a run is long enough."""
    step, limit = ((x[1:] - x[:-1]) ** 2).sum(axis=1), UNBROKEN
    least = min(least, len(x) // 3)
    while True:
        breaks = np.flatnonzero(step >= limit**2) + 1
        ends = np.concatenate([[0], breaks, [len(x)]])
        k = int(np.argmax(np.diff(ends)))
        if ends[k + 1] - ends[k] >= least:
            return int(ends[k]), int(ends[k + 1]) - 1
        limit *= 1.1


def fragment(block: Block, fast: bool) -> np.ndarray:
    """Seed: the shorter of the longest unbroken fragments against the other chain, without gaps; both ways if they are alike."""
    least, j, rows = 8 if fast else 4, np.arange(block.y.shape[1]), []
    for b, (n, m) in enumerate(zip(block.n, block.m, strict=True)):
        runs = [unbroken(block.x[b, :n], least), unbroken(block.y[b, :m], least)]
        lx, ly = (hi - lo + 1 for lo, hi in runs)
        sides = [0, 1] if lx == ly and n == m else [0] if (lx, n) <= (ly, m) else [1]
        for side in sides:
            lo, hi = runs[side]
            own = np.arange(lo, hi + 1)
            if len(own) == min(n, m):
                own = own[int(len(own) * 0.1) : int(len(own) * 0.89) + 1]
            other = m if side == 0 else n
            fewest = min(max(int(min(len(own), other) / 2.5), least - 1), len(own), other)
            if side == 0:
                for k in range(fewest - m, len(own) - fewest + 1, 3 if fast else 1):
                    ok = (j < m) & (j + k >= 0) & (j + k < len(own))
                    rows.append((b, np.where(ok, own[np.clip(j + k, 0, len(own) - 1)], -1)))
            else:
                for k in range(fewest - len(own), n - fewest + 1):
                    match, at = np.full(len(j), -1), np.arange(len(own)) + k
                    ok = (at >= 0) & (at < n)
                    match[own[ok]] = at[ok]
                    rows.append((b, match))
    return _chosen(block, rows, True)


def kinds_and_distance(block: Block, match: np.ndarray) -> np.ndarray:
    """Seed: equal kinds and nearness after the superposition of another match."""
    x, y, count = block.paired(np.arange(len(match)), match)
    r, t = fit(x, y, np.arange(x.shape[1]) < count[:, None])
    return block.match(np.arange(len(match)), r, t, block.scale + 1.5, np.full(len(match), -1.0), 0.5)


def _spread(fast: bool) -> int:
    return 5 if fast else 1


def seeds(block: Block, fast: bool, threaded: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The matches (b, m) that an alignment starts from; ``threaded`` is the first of them, if it is there already."""
    first = thread(block, _spread(fast)) if threaded is None else threaded
    return dict(zip(SEEDS, (first, like_kinds(block), local(block, _spread(fast)), fragment(block, fast)), strict=True))


def refined(block: Block, owner: np.ndarray, match: np.ndarray, turns: np.ndarray, share: np.ndarray, openings: tuple[float, ...] = OPENINGS) -> tuple[np.ndarray, np.ndarray]:
    """(score, match) of each row after superposition and matching in turn, once with each opening.

    A row whose first score is at most ``share`` of the best first score of its pair stays as it is.
    """

    def scored(o: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, count = block.paired(o, own)
        return S.search(x, y, count, block.short[o], block.scale[o], COARSE, block.cap[o])

    first, r, t = scored(owner, match)
    best, kept = first.copy(), match.copy()
    top = np.full(len(block.n), -1.0)
    np.maximum.at(top, owner, first)
    row = np.repeat(np.flatnonzero(first > share * top[owner]), len(openings))
    opening = np.tile(openings, len(row) // len(openings))
    r, t, old = r[row], t[row], np.zeros(len(row))
    for turn in range(int(turns.max(initial=0))):
        own = block.match(owner[row], r, t, block.scale[owner[row]], opening)
        score, r, t = scored(owner[row], own)
        for k in _first_best(row, score):
            if score[k] > best[row[k]]:
                best[row[k]], kept[row[k]] = score[k], own[k]
        on = (turn + 1 < turns[row]) & ((np.abs(score - old) >= 1e-6) if turn else True)
        row, opening, r, t, old = row[on], opening[on], r[on], t[on], score[on]
        if not len(row):
            break
    return best, kept


def _met(block: Block, match: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole, squared gaps, rotation, shift) of the fit of each match; whole: it brings every point of the shorter chain onto one of the other."""
    x, y, count = block.paired(np.arange(len(match)), match)
    valid = np.arange(x.shape[1]) < count[:, None]
    r, t = fit(x, y, valid)
    d2 = np.where(valid, S.gaps(x, y, r, t), 0)
    least = np.array([final_scale(int(k)) for k in block.short])
    return (count == block.short) & (d2.max(axis=1) <= (MEETS * least) ** 2), d2, r, t


def _told(block: Block, k: int, match: np.ndarray, **found) -> dict:
    j = np.flatnonzero(match >= 0)
    return {**found, "scale": final_scale(int(block.m[k])), "i": match[j], "j": j}


def solved(block: Block, fast: bool = True) -> list[dict]:
    """The alignment of each pair.

    A match in which all of the shorter chain meets the other has the highest scores there are,
    since no pair counts more than 1.  So a pair whose chains meet without gaps is done, and the
    others are searched.
    """
    threaded = thread(block, _spread(fast))
    whole, d2, r, t = _met(block, threaded)
    found = iter(_searched(block.part(~whole), threaded[~whole, : block.m[~whole].max(initial=0)], fast)) if not whole.all() else iter(())
    out = []
    for k, done in enumerate(whole):
        if done:
            near = (d2[k] / final_scale(int(length)) ** 2 for length in (block.m[k], block.n[k]))
            tm, tm_query = ((1 / (1 + d[: block.short[k]])).sum() / length for d, length in zip(near, (block.m[k], block.n[k]), strict=True))
            out.append(_told(block, k, threaded[k], tm=tm, tm_query=tm_query, rmsd=np.sqrt(d2[k].sum() / block.short[k]), rotation=r[k].ravel(), shift=t[k]))
        else:
            out.append(next(found))
    return out


def _searched(block: Block, threaded: np.ndarray, fast: bool) -> list[dict]:
    """The best of five seeds, cut at the distance that a score counts, and both final scores."""
    b, long = len(block.n), 2 if fast else 30
    every = np.arange(b)
    begun = seeds(block, fast, threaded)
    owner, match = np.tile(every, len(begun)), np.concatenate(list(begun.values()))
    name = np.repeat(list(begun), b)
    few = np.where(block.short <= 40, 0.1, 0.4)
    share = np.select([name == "thread", name == "kinds"], [-1.0, 0.2], few[owner])
    score, match = refined(block, owner, match, np.where(np.isin(name, ("thread", "kinds")), long, 2), share)
    rows = _first_best(owner, score)
    top, best = score[rows], match[rows]
    more, again = refined(block, every, kinds_and_distance(block, best), np.full(b, long), few * 0)
    best = np.where((more > top)[:, None], again, best)
    x, y, count = block.paired(every, best)
    _, r, t = S.search(x, y, count, np.maximum(count, 1), block.scale, COARSE if fast else 1, block.cap)
    scales = [np.array([final_scale(int(k)) for k in length]) for length in (block.m, block.n)]

    def near(owner: np.ndarray, match: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
        """Without the pairs that are farther than the score counts, and the coarse score of the rest over the target's length."""
        x, y, count = block.paired(owner, match)
        far = (S.gaps(x, y, r, t) > (block.cap[owner] ** 2)[:, None]) & (np.arange(x.shape[1]) < count[:, None])
        out, column = match.copy(), np.argsort(match < 0, axis=1, kind="stable")[:, : x.shape[1]]
        at = np.nonzero(far)
        out[at[0], column[at]] = -1
        x, y, count = block.paired(owner, out)
        return out, *S.search(x, y, count, block.m[owner], scales[0][owner], COARSE)

    cut, tm, r, t = near(every, best, r, t)
    # matched anew at the final scale with either opening, while that scores more
    for _ in range(2):
        both, opening = np.tile(every, 2), np.repeat(OPENINGS, b)
        found = near(both, block.match(both, r[both], t[both], scales[0][both], opening), r[both], t[both])
        row = _first_best(both, found[1])
        more = found[1][row] > tm
        cut, tm, r, t = (np.where(more.reshape(-1, *[1] * (old.ndim - 1)), new[row], old) for new, old in zip(found, (cut, tm, r, t), strict=True))
    x, y, count = block.paired(every, cut)
    valid = np.arange(x.shape[1]) < count[:, None]
    apart = np.sqrt(np.where(valid, S.gaps(x, y, *fit(x, y, valid)), 0).sum(axis=1) / np.maximum(count, 1))
    tm, r, t = S.settled(x, y, count, block.m, scales[0], *S.search(x, y, count, block.m, scales[0], 1))
    tm_query, other = tm.copy(), np.flatnonzero(block.n != block.m)
    if len(other):
        own = (x[other], y[other], count[other], block.n[other], scales[1][other])
        tm_query[other], _, _ = S.settled(*own, *S.search(*own, 1))
    return [_told(block, k, cut[k], tm=max(tm[k], 0.0), tm_query=max(tm_query[k], 0.0), rmsd=apart[k], rotation=r[k].ravel(), shift=t[k]) for k in every]


def one(x: np.ndarray, y: np.ndarray, fast: bool = True) -> dict:
    """The alignment of one pair."""
    return solved(Block.of([(x, y, kinds(x), kinds(y))]), fast)[0]


def densest(i: np.ndarray, n: int) -> tuple[int, int]:
    """(first place, count) of the fullest window of n places of a doubled chain; the last start is not tried."""
    sums = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=2 * n))])
    held = sums[n : 2 * n - 1] - sums[: n - 1]
    return int(np.argmax(held)), int(held.max())


# Spark


def packed_chains(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, xyz): each chain's coordinates in order as one array."""
    rows = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "z"))).alias("p"))
    return rows.select(*keys, F.flatten(F.transform("p", lambda s: F.array(s["x"], s["y"], s["z"]))).alias("xyz"))


def dealt(pairs: DataFrame, query: str = "query", target: str = "target", cells: int = TASK_CELLS) -> DataFrame:
    """``pairs`` over as many tasks as hold ``cells`` matrix cells each, and one for each core at least.

    A number that is asked for is kept by adaptive execution, which would merge rows by their bytes.
    """
    size = F.coalesce(F.size(query).cast("long"), F.lit(0)) * F.coalesce(F.size(target).cast("long"), F.lit(0)) / 9
    total, n = pairs.agg(F.coalesce(F.sum(size), F.lit(0.0)), F.count("*")).first()
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.repartition(max(1, min(max(cores, int(-(-total // cells))), n)))


ALIGNMENT = pa.struct(
    [(c, pa.float64()) for c in ("tm", "tm_query", "rmsd", "scale")]
    + [("i", pa.list_(pa.int32())), ("j", pa.list_(pa.int32())), ("rotation", pa.list_(pa.float64())), ("shift", pa.list_(pa.float64())), ("cut", pa.int32()), ("held", pa.int32())]
)
_ALIGNMENT_SQL = "struct<tm:double,tm_query:double,rmsd:double,scale:double,i:array<int>,j:array<int>,rotation:array<double>,shift:array<double>,cut:int,held:int>"


def _chains(column: pa.Array) -> list[np.ndarray | None]:
    out = []
    for v in column:
        p = None if not v.is_valid else v.values.to_numpy(zero_copy_only=False).astype(float)
        out.append(p.reshape(-1, 3) if p is not None and len(p) >= 12 and np.isfinite(p).all() else None)
    return out


def _blocks(pairs: list[tuple]) -> Iterator[tuple[list[int], Block]]:
    """Pairs of like size together, as many as are matched in step."""
    order = sorted((k for k, p in enumerate(pairs) if p is not None), key=lambda k: (max(len(pairs[k][0]), len(pairs[k][1])), len(pairs[k][0])))
    at = 0
    while at < len(order):
        size = 1
        while at + size < len(order):
            n, m = (max(len(pairs[k][side]) for k in order[at : at + size + 1 : max(size, 1)]) for side in (0, 1))
            if size + 1 > max(1, at_once(n, m) // PROBLEMS):
                break
            size += 1
        own = order[at : at + size]
        yield own, Block.of([pairs[k] for k in own])
        at += size


def aligned(pairs: DataFrame, name: str, query: str = "query", target: str = "target", doubled: bool = False, turn: Column | None = None, fast: bool = True) -> DataFrame:
    """``pairs`` with the column ``name``: the alignment of the query (moved) with the target, or null.

    ``doubled`` aligns the query followed by itself and adds its densest window (cut, held);
    ``turn`` is how far the query's order is turned first, and null leaves a pair out.  Null
    where a chain has under four points or a coordinate that is no number.  i and j are places
    in the chains as aligned.
    """
    names = pairs.columns
    inputs = pairs.select("*", (F.lit(0) if turn is None else turn).cast("int").alias("_turn"))
    schema = ", ".join([*(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in names), f"`{name}` {_ALIGNMENT_SQL}"])
    at = [names.index(query), names.index(target)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column(len(names)).to_pylist()
            found: list[dict | None] = [None] * batch.num_rows
            pairs = []
            for x, y, k in zip(_chains(batch.column(at[0])), _chains(batch.column(at[1])), turns, strict=True):
                if x is None or y is None or k is None:
                    pairs.append(None)
                    continue
                kx = kinds(x)
                pairs.append((np.tile(x, (2, 1)), y, np.tile(kx, 2), kinds(y)) if doubled else (np.roll(x, -k, axis=0), y, np.roll(kx, -k), kinds(y)))
            for own, block in _blocks(pairs):
                for k, got in zip(own, solved(block, fast), strict=True):
                    got["cut"], got["held"] = densest(got["i"], len(pairs[k][0]) // 2) if doubled else (turns[k], len(got["i"]))
                    found[k] = got
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, ALIGNMENT)], [*names, name])

    return inputs.mapInArrow(run, schema)


def seed_scores(pairs: DataFrame, *keep: str, fast: bool = True) -> DataFrame:
    """(keep, seed, matched, score): how many residues each seed matches, and its fast score over the shorter chain; pairs that ``aligned`` leaves out have no row."""
    schema = ", ".join([*(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep), "seed string, matched int, score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(x, y, kinds(x), kinds(y)) if x is not None and y is not None else None for x, y in zip(*(_chains(batch.column(len(keep) + k)) for k in (0, 1)), strict=True)]
            for own, block in _blocks(pairs):
                every = np.arange(len(own))
                for name, match in seeds(block, fast).items():
                    score = np.where((match >= 0).any(axis=1), block.fast(every, match), 0) / block.short
                    rows = batch.select(range(len(keep))).take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([name] * len(own)), pa.array((match >= 0).sum(axis=1), pa.int32()), pa.array(score)], [*keep, "seed", "matched", "score"])

    return pairs.select(*keep, "query", "target").mapInArrow(run, schema)


def permuted(pairs: DataFrame, query: str = "query", target: str = "target", thorough: bool = False) -> DataFrame:
    """``pairs`` with once (in order), moved (the query turned by its cut, or null) and cut (0: none).

    The cut is the densest window of the doubled query; one that holds fewer pairs than the
    order itself is dropped.  None is looked for where the order itself brings all of the shorter
    chain onto the other, since no turned one can score more.
    """
    short = F.least(F.size(query), F.size(target)) / 3
    whole = (F.size("once.i") == short) & (F.col("once.tm") * F.size(target) / 3 >= short * (1 - MEETS**2))
    rows = aligned(aligned(pairs, "once", query, target), "_twice", query, target, doubled=True, turn=F.when(~F.coalesce(whole, F.lit(False)), 0))
    cut = F.when(F.col("_twice.held") >= F.size("once.i"), F.col("_twice.cut")).otherwise(0)
    rows = rows.withColumn("cut", F.coalesce(cut, F.lit(0))).drop("_twice")
    turn = F.when((F.col("cut") > 0) | F.lit(thorough), F.col("cut"))
    return aligned(rows, "moved", query, target, turn=turn, fast=not thorough)


def _rmsd_of(x: Column, y: Column) -> Column:
    @F.pandas_udf("double")
    def same_length(q, t):
        import pandas as pd

        out = []
        for a, b in zip(q, t, strict=True):
            fits = a is not None and b is not None and len(a) == len(b) >= 12
            out.append(rmsd(np.reshape(np.array(a, float), (-1, 3)), np.reshape(np.array(b, float), (-1, 3))) if fits else None)
        return pd.Series(out, dtype="float64")

    return same_length(x, y)


def scored_pairs(pairs: DataFrame, *keep: str, fast: bool | None = False) -> DataFrame:
    """Pairs (.., query, target) to (.., rmsd, tm, tm_cp, cut); rmsd of chains of one length, else null.

    Chains under four residues are kept without scores.  With ``fast`` no permutation is
    tried; with None nothing but the rmsd is.  A cut of -1 says that the order stays.
    """
    rows = dealt(pairs.select(*keep, "query", "target"))
    none = F.lit(None)
    tm, tm_cp, cut = none.cast("double"), none.cast("double"), none.cast("int")
    if fast is not None:
        rows = aligned(rows, "once") if fast else permuted(rows)
        tm = F.col("once.tm")
    if fast is False:
        tm_cp = F.coalesce("moved.tm", "once.tm")
        cut = F.when(F.col("once").isNotNull(), F.when(F.col("cut") > 0, F.col("cut")).otherwise(-1)).cast("int")
    return rows.select(*keep, _rmsd_of(F.col("query"), F.col("target")).alias("rmsd"), tm.alias("tm"), tm_cp.alias("tm_cp"), cut.alias("cut"))


def verified(scored: DataFrame, least: float = 0.5) -> DataFrame:
    """Drops what was judged below ``least``; what was not judged stays."""
    tm = F.greatest("tm", "tm_cp")
    return scored.withColumn("verdict", tm).where(F.col("verdict").isNull() | (F.col("verdict") >= least))


def _point(xyz: str, i: Column) -> list[Column]:
    return [F.element_at(xyz, (3 * i + k + 1).cast("int")) for k in range(3)]


def modes(permuted_pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, query, target, mode, alignment, turn, preferred): the order itself as "seq" and, where it was tried, the turned one as "cp".

    Preferred is the turned one only if it scores strictly more.
    """
    better = F.coalesce(F.col("moved.tm") > F.col("once.tm"), F.lit(False))
    both = F.array(
        F.struct(F.lit("seq").alias("mode"), F.col("once").alias("alignment"), F.lit(0).alias("turn"), (~better).alias("preferred")),
        F.struct(F.lit("cp").alias("mode"), F.col("moved").alias("alignment"), F.col("cut").cast("int").alias("turn"), better.alias("preferred")),
    )
    rows = permuted_pairs.select(*keys, "query", "target", F.explode(both).alias("m"))
    return rows.select(*keys, "query", "target", "m.*").where("alignment is not null")


def path(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, mode, i, j, d2, closeness, preferred): the matched residues in their own numbering, after the superposition.

    A turned query is numbered as it was given: place p is residue (p + turn) modulo its length.
    """
    n = (F.size("query") / 3).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.size("alignment.i") - 1), lambda k: F.struct(F.get("alignment.i", k).alias("p"), F.get("alignment.j", k).alias("j")))
    steps = rows.where(F.size("alignment.i") > 0).select(*keys, "mode", "query", "target", "alignment", "preferred", "turn", F.explode(pairs).alias("s"))
    steps = steps.withColumn("i", ((F.col("s.p") + F.col("turn")) % n).cast("int"))
    d2 = sum((a - b) ** 2 for a, b in zip(_moved("query", F.col("i")), _point("target", F.col("s.j")), strict=True))
    return steps.select(*keys, "mode", "i", F.col("s.j").alias("j"), d2.alias("d2"), (1 / (1 + d2 / F.col("alignment.scale") ** 2)).alias("closeness"), "preferred")


def given(points_q: DataFrame, points_t: DataFrame, key: str, rotation: list[list[float]], shift: list[float]) -> DataFrame:
    """(key, i, d2, closeness) of residues of one index under a given transform of the query; the scale is that of the target's length."""
    place = [sum(F.col(f"q.{c}") * rotation[k][m] for m, c in enumerate("xyz")) + shift[k] for k in range(3)]
    d2 = sum((place[k] - F.col(f"t.{c}")) ** 2 for k, c in enumerate("xyz"))
    n = points_t.groupBy(key).agg(F.count("*").alias("n"))
    both = points_q.alias("q").join(points_t.alias("t"), [key, "i"]).select(key, "i", d2.alias("d2")).join(n, key)
    scale = F.when(F.col("n") <= 21, 0.5).otherwise(F.greatest(F.lit(0.5), 1.24 * F.cbrt(F.col("n") - 15) - 1.8))
    return both.select(key, "i", "n", "d2", (1 / (1 + F.col("d2") / scale**2)).alias("closeness"))


def _moved(xyz: str, i: Column) -> list[Column]:
    """A point of the query in the frame of the target."""
    p = _point(xyz, i)
    return [sum(F.element_at("alignment.rotation", 3 * a + b + 1) * p[b] for b in range(3)) + F.element_at("alignment.shift", a + 1) for a in range(3)]


def _back(xyz: str, i: Column) -> list[Column]:
    """A point of the target in the frame of the query: the transposed rotation after the shift is undone."""
    p = [c - F.element_at("alignment.shift", k + 1) for k, c in enumerate(_point(xyz, i))]
    return [sum(F.element_at("alignment.rotation", 3 * b + a + 1) * p[b] for b in range(3)) for a in range(3)]


def _points_of(rows: DataFrame, keys: tuple[str, ...], xyz: str, place) -> DataFrame:
    each = rows.select(*keys, "mode", "query", "target", "alignment", F.explode(F.sequence(F.lit(0), (F.size(xyz) / 3).cast("int") - 1)).alias("i"))
    return each.select(*keys, "mode", "i", *[c.alias(k) for k, c in zip("xyz", place(xyz, F.col("i")), strict=True)])


def fitted(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, mode, i, x, y, z): the query brought to the target, in its own numbering (turning moves no point)."""
    return _points_of(rows, keys, "query", _moved)


def brought(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, mode, i, x, y, z): the target brought to the query."""
    return _points_of(rows, keys, "target", _back)
