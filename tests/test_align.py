"""Alignment kernels against plain versions of their rules, and the Spark operators around them."""

from __future__ import annotations

import math
import time

import numpy as np
import pytest

from foldlake.operators import align, geometry, paths, superpose
from tests.test_kernels import points, turned, walk


def plain_fit(x, y):
    cx, cy = x.mean(axis=0), y.mean(axis=0)
    u, _, v = np.linalg.svd((y - cy).T @ (x - cx))
    u[:, 2] *= np.sign(np.linalg.det(u) * np.linalg.det(v))
    return u @ v, cy - u @ v @ cx


def plain_gaps(x, y, r, t):
    return np.array([sum((r[a] @ p + t[a] - q[a]) ** 2 for a in range(3)) for p, q in zip(x, y, strict=True)])


def plain_fast(x, y, scale):
    """All pairs, then those within reach, then those a little farther."""
    reach, best, own = min(max(scale, 4.5), 8.0), -1.0, np.arange(len(x))
    for more in (0, 1, None):
        r, t = plain_fit(x[own], y[own])
        d2 = plain_gaps(x, y, r, t)
        best = max(best, sum(1 / (1 + d / scale**2) for d in d2))
        if more is not None:
            cut = reach**2 + more
            while len(x) > 3 and sum(d <= cut for d in d2) < 3:
                cut += 0.5
            own = np.array([k for k, d in enumerate(d2) if d <= cut])
    return best


def plain_search(x, y, length, scale, cap, step):
    """Every fragment on its own, one pair after another."""
    reach, best = min(max(scale, 4.5), 8.0), -1.0
    for lo, size in zip(*superpose.fragments(len(x), step), strict=True):
        own = list(range(lo, lo + size))
        for turn in range(21):
            r, t = plain_fit(x[own], y[own])
            d2 = plain_gaps(x, y, r, t)
            best = max(best, sum(1 / (1 + d / scale**2) for d in d2 if d <= cap**2) / length)
            cut = reach + (1 if turn else -1)
            grown, more = cut, 0
            while len(x) > 3 and sum(d < grown**2 for d in d2) < 3:
                more += 1
                grown = cut + 0.5 * more
            new = [k for k, d in enumerate(d2) if d < grown**2]
            if turn and new == own:
                break
            own = new
            if not own:
                break
    return best


def plain_match(gain, opening):
    n, m = gain.shape
    v, hit = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), bool)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d, up, left = v[i - 1, j - 1] + gain[i - 1, j - 1], v[i - 1, j] + opening * hit[i - 1, j], v[i, j - 1] + opening * hit[i, j - 1]
            hit[i, j], v[i, j] = d >= up and d >= left, max(d, up, left)
    out, i, j = np.full(m, -1), n, m
    while i and j:
        if hit[i, j]:
            i, j = i - 1, j - 1
            out[j] = i
        elif v[i, j - 1] + opening * hit[i, j - 1] >= v[i - 1, j] + opening * hit[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return out


def of_match(x, y, match):
    j = np.flatnonzero(match >= 0)
    return x[match[j]], y[j]


def block_of(*pairs):
    return align.Block.of([(x, y, align.kinds(x), align.kinds(y)) for x, y in pairs])


PAIRS = [(walk(31, 1), walk(26, 2)), (walk(26, 3), walk(31, 4)), (walk(40, 5), turned(walk(40, 5) + np.random.default_rng(0).normal(0, 2, (40, 3)))), (walk(12, 6), walk(40, 7))]


@pytest.mark.parametrize("opening", [-0.6, 0.0, -1.0])
def test_matching_in_step_equals_plain_dynamic_programming(opening):
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, m = rng.integers(1, 12, 6), rng.integers(1, 12, 6)
        gain = np.round(rng.random((6, n.max(), m.max())) - 0.2, 1)
        got = paths.matched(paths.by_table(gain), n, m, np.full(6, opening))
        for b in range(6):
            assert np.array_equal(got[b, : m[b]], plain_match(gain[b, : n[b], : m[b]], opening)) and (got[b, m[b] :] == -1).all()


def test_gains_of_distances_and_kinds_equal_their_tables():
    block = block_of(*PAIRS)
    every = np.arange(len(PAIRS))
    d2 = ((block.x[:, :, None] - block.y[:, None]) ** 2).sum(axis=3)
    same = (block.kx[:, :, None] == block.ky[:, None]).astype(float)
    near = 1 / (1 + d2 / 25)
    cases = ((paths.by_distance(block.x, block.y, np.full(4, 5.0)), near), (paths.by_kind(block.kx, block.ky), same), (paths.by_distance(block.x, block.y, np.full(4, 5.0), paths.by_kind(block.kx, block.ky), 0.5), near + 0.5 * same))
    for gain, table in cases:
        assert np.array_equal(paths.matched(gain, block.n, block.m, np.full(len(every), -0.6)), paths.matched(paths.by_table(table), block.n, block.m, np.full(len(every), -0.6)))


def test_fast_scores_equal_the_plain_rounds():
    rng = np.random.default_rng(1)
    for _ in range(25):
        n = int(rng.integers(3, 40))
        x, y = walk(n, int(rng.integers(1e6))), walk(n, int(rng.integers(1e6))) * rng.choice([1, 4])
        scale = float(rng.choice([0.97, 3.0, 6.0]))
        got = superpose.fast_score(x[None], y[None], np.ones((1, n), bool), np.array([scale]))[0]
        assert abs(got - plain_fast(x, y, scale)) < 1e-7


@pytest.mark.parametrize("step", [40, 1])
def test_searches_equal_the_plain_search(step):
    rng = np.random.default_rng(2)
    cases = [(walk(n, n), turned(walk(n, n + int(rng.integers(2)))) + rng.normal(0, 2, (n, 3))) for n in (3, 4, 5, 9, 30, 45)]
    x, y = (np.zeros((len(cases), 45, 3)) for _ in range(2))
    for k, (a, b) in enumerate(cases):
        x[k, : len(a)], y[k, : len(b)] = a, b
    count = np.array([len(a) for a, _ in cases])
    scale, cap = np.full(len(cases), 2.0), np.full(len(cases), 7.0)
    got, r, t = superpose.search(x, y, count, count, scale, step, cap)
    for k, (a, b) in enumerate(cases):
        assert abs(got[k] - plain_search(a, b, len(a), 2.0, 7.0, step)) < 1e-6
        d2 = plain_gaps(a, b, r[k], t[k])
        assert abs(got[k] - sum(1 / (1 + d / 4) for d in d2 if d <= 49) / len(a)) < 1e-9
    best, _, _ = superpose.settled(x, y, count, count, scale, *superpose.search(x, y, count, count, scale, step))
    assert (best >= got - 1e-12).all()


def test_gapless_seeds_equal_the_plain_threading():
    block = block_of(*PAIRS)
    for step in (1, 5):
        got = align.thread(block, step)
        for k, (x, y) in enumerate(PAIRS):
            n, m, best = len(x), len(y), -1
            least = min(max(min(n, m) // 2, 5), min(n, m))
            for shift in range(least - m, n - least + 1, step):
                j = np.array([q for q in range(m) if 0 <= q + shift < n])
                score = plain_fast(x[j + shift], y[j], block.scale[k])
                if score >= best - 1e-9:
                    best, want = score, {int(q): int(q + shift) for q in j}
            assert {int(j): int(got[k, j]) for j in np.flatnonzero(got[k] >= 0)} == want


def test_local_seeds_equal_plain_fragments():
    block = block_of(*PAIRS)
    got = align.local(block)
    for k, (x, y) in enumerate(PAIRS):
        n, m, best = len(x), len(y), 0.0
        for size in (min(20, min(n, m) // 3), min(100, min(n, m) // 2)):
            for i in range(0, n - size + 1, min(15, n // 3)):
                for j in range(0, m - size + 1, min(15, m // 3)):
                    r, t = plain_fit(x[i : i + size], y[j : j + size])
                    d2 = ((x @ r.T + t)[:, None] - y[None]) ** 2
                    match = plain_match(1 / (1 + d2.sum(axis=2) / (block.scale[k] + 1.5) ** 2), 0.0)
                    best = max(best, plain_fast(*of_match(x, y, match), block.scale[k]))
        assert abs(plain_fast(*of_match(x, y, got[k, :m]), block.scale[k]) - best) < 1e-6


def test_fragment_seeds_slide_the_longest_unbroken_run():
    x = walk(50, 8)
    x[20:] += 30.0  # a break before 20
    assert align.unbroken(x, 4) == (20, 49) and align.unbroken(x[:30], 4) == (0, 19)
    assert align.unbroken(walk(9, 1) * 3, 4)[1] >= 2  # steps of 11.4 are unbroken once the limit has grown
    y = turned(x[20:])
    match = align.fragment(block_of((x, y)), False)[0]
    held = np.flatnonzero(match >= 0)
    assert len(held) >= 20 and (match[held] == held + 20).all()


def test_seeds_of_kinds_equal_plain_matching():
    t = np.arange(40) * math.radians(100)
    helix = np.stack([2.3 * np.cos(t), 2.3 * np.sin(t), 1.5 * np.arange(40)], axis=1)
    pairs = [(helix, helix[:25]), (np.concatenate([helix[:20], walk(20, 1) + helix[20]]), walk(30, 2))]
    block = block_of(*pairs)
    got = align.like_kinds(block)
    for k, (x, y) in enumerate(pairs):
        same = (align.kinds(x)[:, None] == align.kinds(y)[None]).astype(float)
        assert np.array_equal(got[k, : len(y)], plain_match(same, -1.0))
        start = align.thread(block)[k, : len(y)]
        r, shift = plain_fit(*of_match(x, y, start))
        d2 = (((x @ r.T + shift)[:, None] - y[None]) ** 2).sum(axis=2)
        both = align.kinds_and_distance(block, align.thread(block))[k, : len(y)]
        assert np.array_equal(both, plain_match(1 / (1 + d2 / (block.scale[k] + 1.5) ** 2) + 0.5 * same, -1.0))


def test_kinds_equal_secondary_structure(spark):
    t = np.arange(30) * math.radians(100)
    x = np.concatenate([np.stack([2.3 * np.cos(t), 2.3 * np.sin(t), 1.5 * t / math.radians(100)], axis=1), walk(40, 3) + 60, np.stack([3.3 * np.arange(20), np.arange(20) % 2, 0 * t[:20]], axis=1)])
    rows = geometry.secondary_structure(points(spark, x), "chain").orderBy("i").collect()
    assert "".join(r.ss for r in rows) == "".join("CTEH"[k] for k in align.kinds(x))


def earlier(x, y):
    """A simpler aligner: the three best gapless offsets, then whole-chain fits and matching in turn."""
    n, m, scale = len(x), len(y), superpose.search_scale(min(len(x), len(y)))

    def best_fit(a, b, s):
        best, reach = (-1.0, None, None), min(max(s, 4.5), 8.0)
        starts = [(lo, size) for size in {len(a) >> k for k in range(6)} if size >= 4 for lo in range(0, len(a) - size + 1, max(1, size // 2))]
        for lo, size in starts:
            own = np.arange(lo, lo + size)
            for _ in range(8):
                r, t = plain_fit(a[own], b[own])
                d2 = ((a @ r.T + t - b) ** 2).sum(axis=1)
                score = (1 / (1 + d2 / s**2)).sum() / m
                if score > best[0]:
                    best = (score, r, t)
                own = np.flatnonzero(d2 <= max(reach**2, np.sort(d2)[min(2, len(a) - 1)]))
        return best

    seeds = []
    for k in range(max(4, min(n, m) // 2) - m, n - max(4, min(n, m) // 2) + 1):
        j = np.arange(max(0, -k), min(m, n - k))
        r, t = plain_fit(x[j + k], y[j])
        seeds.append(((1 / (1 + ((x[j + k] @ r.T + t - y[j]) ** 2).sum(axis=1) / scale**2)).sum(), k, j))
    best = 0.0
    for _, k, j in sorted(seeds, key=lambda s: -s[0])[:2]:
        i = j + k
        for _ in range(3):
            score, r, t = best_fit(x[i], y[j], scale)
            d2 = (((x @ r.T + t)[:, None] - y[None]) ** 2).sum(axis=2)
            match = plain_match(1 / (1 + d2 / scale**2), -0.6)
            j = np.flatnonzero(match >= 0)
            i = match[j]
        near = ((x[i] @ r.T + t - y[j]) ** 2).sum(axis=1) <= superpose.score_cutoff(min(n, m)) ** 2
        best = max(best, best_fit(x[i[near]], y[j[near]], superpose.final_scale(m))[0])
    return best


@pytest.mark.parametrize("seed", range(8))
def test_noisy_gapped_copies_score_no_less_than_a_simpler_aligner(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(30, 70))
    x, keep = walk(n, seed), np.ones(n, bool)
    for _ in range(3):
        at = int(rng.integers(0, n - 6))
        keep[at : at + int(rng.integers(1, 6))] = False
    y = turned(x[keep] + rng.normal(0, rng.choice([0.5, 1.5, 3.0]), (keep.sum(), 3)))
    found = align.one(x, y)
    assert found["tm"] >= earlier(x, y) - 1e-9
    assert (np.diff(found["i"]) > 0).all() and (np.diff(found["j"]) > 0).all()
    assert align.one(x, y, fast=False)["tm"] >= found["tm"] - 0.03


def test_rigid_motion_changes_no_score():
    x = walk(60)
    assert align.rmsd(x, turned(x)) < 1e-8
    found = align.one(x, turned(x))
    assert abs(found["tm"] - 1) < 1e-9 and np.array_equal(found["i"], found["j"]) and len(found["i"]) == 60 and found["rmsd"] < 1e-6


def test_a_pair_of_three_hundred_is_verified_in_time():
    x, y = walk(300, 1), walk(300, 2)
    align.one(x, y)
    began = time.process_time()
    align.one(x, y)
    assert time.process_time() - began < 8  # 0.6 s where nothing else runs


def pairs_of(spark, rows):
    flat = lambda x: None if x is None else [float(v) for v in np.ravel(x)]
    return spark.createDataFrame([(k, flat(x), flat(y)) for k, x, y in rows], "id int, query array<double>, target array<double>")


@pytest.mark.parametrize("cut", [9, 20, 41])
def test_a_circular_permutation_is_recovered(spark, cut):
    x = walk(60, 3)
    pairs = pairs_of(spark, [(0, np.roll(x, cut, axis=0), turned(x)), (1, x, turned(x))])
    rows = align.permuted(pairs)
    got = {r["id"]: r for r in rows.collect()}
    assert got[0]["cut"] == cut and got[0]["moved"]["tm"] > 0.999 > got[0]["once"]["tm"]
    assert got[1]["cut"] == 0 and got[1]["moved"] is None and got[1]["once"]["tm"] > 0.999
    steps = align.path(align.modes(rows, "id"), "id").where("preferred").collect()
    assert {(r["id"], r["mode"], r["i"], r["j"]) for r in steps} == {(0, "cp", (j + cut) % 60, j) for j in range(60)} | {(1, "seq", j, j) for j in range(60)}
    assert max(r["d2"] for r in steps) < 1e-9 and min(r["closeness"] for r in steps) > 1 - 1e-9
    back = align.brought(align.modes(rows, "id"), "id").where("id = 1").orderBy("i").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in back], x)
    there = align.fitted(align.modes(rows, "id"), "id").where("id = 0 and mode = 'cp'").orderBy("i").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in there], np.roll(turned(x), cut, axis=0))


def test_pairs_without_a_chain_stay_without_scores(spark):
    x = walk(20)
    pairs = pairs_of(spark, [(0, x[:3], x), (1, None, x), (2, x, None), (3, [[float("nan")] * 3] * 5, x), (4, x, x), (5, x[:4], x[:4]), (6, np.zeros((6, 3)), x)])
    got = {r["id"]: r for r in align.scored_pairs(pairs, "id").collect()}
    assert len(got) == 7 and all(got[k]["tm"] is None and got[k]["cut"] is None for k in range(4))
    assert got[4]["tm"] > 0.999 and got[4]["cut"] == -1 and got[5]["tm"] > 0.999 and got[6]["tm"] is not None
    assert align.scored_pairs(pairs.limit(0), "id").count() == 0


def test_pairs_are_dealt_by_their_cells(spark):
    x = walk(40)
    pairs = pairs_of(spark, [(k, x, x) for k in range(64)]).coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert align.dealt(pairs).rdd.getNumPartitions() == cores
    many = align.dealt(pairs, cells=3200)
    assert many.rdd.getNumPartitions() == 32 and max(many.rdd.glom().map(len).collect()) <= 4
    assert align.dealt(pairs.limit(0)).count() == 0


def test_the_fullest_window_is_the_first_of_its_kind():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(4, 12))
        i = np.flatnonzero(rng.random(2 * n) < 0.5)
        held = [int(((i >= r) & (i < r + n)).sum()) for r in range(n - 1)]
        assert align.densest(i, n) == (held.index(max(held)), max(held))


def test_scores_under_a_given_transform(spark):
    x, y = walk(30, 1), walk(30, 2)
    rows = align.given(points(spark, x), points(spark, y), "chain", [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]], [1.0, 2.0, 3.0]).orderBy("i").collect()
    d2 = plain_gaps(x, y, np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]]), np.array([1.0, 2, 3]))
    assert np.allclose([r["d2"] for r in rows], d2) and np.allclose([r["closeness"] for r in rows], 1 / (1 + d2 / superpose.final_scale(30) ** 2))
