"""Domain parsing against dense and plain versions of its rules."""

from __future__ import annotations

import math
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.functions import expressions as X
from foldlake.operators import domains as D
from foldlake.operators import geometry, segments
from tests.test_kernels import points, walk


def contact_table(x, within=8.0):
    w = (np.linalg.norm(x[:, None] - x[None], axis=2) < within).astype(float)
    np.fill_diagonal(w, 0)
    k = np.arange(len(x) - 1)
    w[k, k + 1] = w[k + 1, k] = 2
    return w


def dense_second(w):
    s = 1 / np.sqrt(w.sum(axis=1))
    return np.linalg.eigh(w * s[:, None] * s[None])[1][:, -2]


@pytest.mark.parametrize("n", [3, 40, 150, 400])
def test_second_vectors_order_nodes_like_dense_ones(n):
    w = contact_table(walk(n, n))
    got, want = D.second_vector(D.Graph.dense(w)), dense_second(w)
    want = want if want @ got > 0 else -want
    assert np.abs(got - want).max() < 1e-6
    assert np.array_equal(np.argsort(np.round(got, 7), kind="stable"), np.argsort(np.round(want, 7), kind="stable"))


def test_spectra_equal_dense_ones():
    w = contact_table(walk(90, 2))
    s = 1 / np.sqrt(w.sum(axis=1))
    want = np.sort(1 - np.linalg.eigvalsh(w * s[:, None] * s[None]))[1:9]
    assert np.abs(D.spectrum(D.Graph.dense(w), 8) - want).max() < 1e-8


def test_a_chain_of_twenty_thousand_needs_no_table():
    n = 20_000
    i = np.arange(n - 1)
    far = np.arange(n - 40)
    a, b = np.concatenate([i, far]), np.concatenate([i + 1, far + 40])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    g = D.Graph.of(n, np.concatenate([a, b]), np.concatenate([b, a]), np.ones(2 * len(a)))
    label = D.labels_of(g, [0.08], most=2)[0]
    assert len(np.unique(label)) == 2 and abs(int((label == 0).sum()) - n // 2) < n // 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # kB


def test_sweeps_equal_direct_sums():
    rng = np.random.default_rng(1)
    w = contact_table(walk(60, 5))
    order = rng.permutation(60)
    score, k = D._sweep(D.Graph.dense(w), order, 10)
    all_scores = {}
    for m in range(10, 51):
        a, b = order[:m], order[m:]
        cut = w[np.ix_(a, b)].sum()
        all_scores[m] = cut / w[a].sum() + cut / w[b].sum()
        assert abs(D.cut_of(D.Graph.dense(w), a, b) - all_scores[m]) < 1e-12
    assert abs(score - min(all_scores.values())) < 1e-12 and abs(all_scores[k] - score) < 1e-12


def blobs(links):
    """Three blobs of 60 in a row; ``links`` pairs tie the second and the third."""
    rng = np.random.default_rng(3)
    w = np.zeros((180, 180))
    for b in range(3):
        own = (rng.random((60, 60)) < 0.5).astype(float)
        w[60 * b : 60 * b + 60, 60 * b : 60 * b + 60] = np.triu(own, 1) + np.triu(own, 1).T
    for k in (59, 119):
        w[k, k + 1] = w[k + 1, k] = 2
    w[10, 100] = w[100, 10] = 1  # the second and third blobs are split last
    return D.Graph.dense(w), np.array([(60 + 5 * k, 179 - 5 * k) for k in range(links)]).reshape(-1, 2)


def test_a_later_cut_leaves_sheets_whole():
    g, sheet = blobs(3)
    plain = D.labels_of(g, [0.08])[0]
    assert len(np.unique(plain)) == 3
    crossed = [D.crossing(sheet, g.n, np.flatnonzero(plain == a), np.flatnonzero(plain == b)) for a, b in ((0, 1), (1, 2))]
    assert crossed == [0, sum((plain[i], plain[j]) == (1, 2) for i, j in sheet)] == [0, 3]
    held = D.labels_of(g, [0.08], sheet=sheet, veto=3)[0]
    assert len(np.unique(held)) == 2 and (held[60:] == held[-1]).all() or len(np.unique(held)) == 3
    assert len(np.unique(D.labels_of(g, [0.08], sheet=sheet, veto=4)[0])) == 3


def test_a_cut_counts_with_its_mean_over_graphs():
    g, _ = blobs(0)
    w = np.zeros((g.n, g.n))
    w[g.i, g.j] = g.w
    glued = D.Graph.dense(np.maximum(w, 1.0) - np.eye(g.n))
    assert len(np.unique(D.labels_of(g, [0.08])[0])) == 3
    assert len(np.unique(D.labels_of(g, [0.08], others=(glued,))[0])) == 1
    assert len(np.unique(D.labels_of(g, [0.08], others=(g, g))[0])) == 3


def plain_generator(seed, n):
    out, a, full = [], seed % 2**32, 2**32 - 1
    for _ in range(n):
        a = (a + 0x9E3779B9) & full
        t = (a ^ a >> 15) * (a | 1) & full
        t ^= (t + ((t ^ t >> 7) * (t | 61) & full)) & full
        out.append(((t ^ t >> 14) & full) / 2**32)
    return out


@pytest.mark.parametrize("seed", [0, 1, 0x9E37 + 4 * 7919, 0x51ED + 3 * 2654435761, 2**32 - 1])
def test_draws_equal_a_plain_generator(spark, seed):
    want = plain_generator(seed, 1000)
    rows = spark.range(1000).select("id", X.seeded_draw(F.lit(seed), F.col("id")).alias("u"), X.seeded_normal(F.lit(seed), F.col("id")).alias("z")).orderBy("id").collect()
    assert [r.u for r in rows] == want
    for k, r in enumerate(rows):
        u, v = max(want[k - k % 2], 1e-12), want[k - k % 2 + 1]
        assert abs(r.z - math.sqrt(-2 * math.log(u)) * (math.sin if k % 2 else math.cos)(2 * math.pi * v)) < 1e-9


def test_perturbed_copies_move_points_and_distance(spark):
    x = walk(70, 4)
    p = points(spark, x)
    moved = {(r.run, r.i): np.array([r.x, r.y, r.z]) for r in D.jittered(p, "chain", 4).collect()}
    assert all(np.allclose(moved[0, i], x[i]) for i in range(70)) and not np.allclose(moved[1, 0], x[0])
    first, step = D.RUN_SEEDS["vote"]
    u = plain_generator(first + 2 * step, 6)
    z = [math.sqrt(-2 * math.log(u[2 * (f // 2)])) * (math.sin if f % 2 else math.cos)(2 * math.pi * u[2 * (f // 2) + 1]) for f in range(6)]
    assert np.allclose(np.concatenate([moved[2, 0], moved[2, 1]]), np.concatenate([x[0], x[1]]) + 0.4 * np.array(z))
    edges = D.perturbed_contacts(p, "chain", 4, use="vote").collect()
    for run, distance in ((0, 8.0), (1, 8.0), (2, 8.4), (3, 7.6)):
        y = np.array([moved[run, i] for i in range(70)])
        own = {(r.i, r.j): r.w for r in geometry.soft_contacts(points(spark, y), "chain", distance).collect()}
        got = {(r.i, r.j): r.w for r in edges if r.run == run}
        assert got.keys() == own.keys() and all(abs(own[k] - got[k]) < 1e-9 for k in own)
    averaged = {(r.i, r.j): r.w for r in D.averaged_contacts(p, "chain", 1).collect()}
    assert averaged == {(r.i, r.j): r.w for r in geometry.soft_contacts(p, "chain").collect()}


def test_learned_weights_equal_plain_cosines(spark):
    x, rng = walk(40, 6), np.random.default_rng(0)
    vectors = rng.normal(0, 1, (2, 40, 8))
    vectors[:, 7] = 0
    p = points(spark, x)
    rows = [(0, run, i, vectors[run, i].tolist()) for run in range(2) for i in range(40) if i != 9]
    df = spark.createDataFrame(rows, "chain int, run int, i int, v array<double>")
    edges = geometry.soft_contacts(p, "chain")
    before = {(r.i, r.j): r.w for r in edges.collect()}
    after = {(r.i, r.j): r.w for r in D.learned_contacts(edges, df, "chain").collect()}
    assert before.keys() == after.keys()
    for (i, j), w in before.items():
        c = np.mean([v[i] @ v[j] / (np.linalg.norm(v[i]) * np.linalg.norm(v[j]) or 1) for v in vectors])
        assert abs(after[i, j] - (w if abs(i - j) == 1 or 9 in (i, j) else w * ((1 + c) / 2) ** 6)) < 1e-9
    assert D.parse(p, "chain", edges=D.learned_contacts(edges, df, "chain")).count() == 40


def test_parse_numbers_every_residue(spark):
    df = points(spark, walk(100, 1)).union(points(spark, walk(1, 2), 5)).union(points(spark, walk(3, 2), 6))
    found = D.parse(df, "chain", veto=2, score_runs=2)
    assert {(r.chain, r.n) for r in found.groupBy("chain").agg(F.count("*").alias("n")).collect()} == {(0, 100), (5, 1), (6, 3)}
    runs = D.consensus_runs(df, "chain", 3)
    assert runs.count() == 3 * 104
    once = {(r.chain, r.i): r.label for r in D.parse(df, "chain").collect()}
    assert {(r.chain, r.i): r.label for r in runs.where("run = 0").collect()} == once


def plain_trim(label, stability, least, keep):
    label = list(label)
    for d in sorted({x for x in label if x is not None}):
        own = [k for k, x in enumerate(label) if x == d]
        if len(own) < least:
            continue
        floor, lo, hi = max(least, math.ceil(len(own) * keep)), 0, len(own) - 1
        while hi - lo + 1 > floor and stability[own[lo]] < 0.999:
            lo += 1
        while hi - lo + 1 > floor and stability[own[hi]] < 0.999:
            hi -= 1
        for k in (*own[:lo], *own[hi + 1 :]):
            label[k] = None
    return label


def test_unstable_ends_are_trimmed_like_the_plain_rule(spark):
    rng, rows, want = np.random.default_rng(4), [], {}
    for chain in range(60):
        n = int(rng.integers(1, 40))
        label = np.sort(rng.integers(0, 3, n)).tolist() if chain % 2 else rng.integers(0, 3, n).tolist()
        stability = rng.choice([0.5, 1.0], n, p=[0.6, 0.4]).tolist() if chain % 5 else [0.5] * n
        rows += [(chain, i, label[i], stability[i]) for i in range(n)]
        want |= {(chain, i): x for i, x in enumerate(plain_trim(label, stability, 4, 0.45))}
    df = spark.createDataFrame(rows, "chain int, i int, label int, stability double")
    assert {(r.chain, r.i): r.label for r in segments.trim_unstable(df, "chain", "i", "label", "stability", least=4).collect()} == want
