"""Operators against plain versions on generated inputs."""

from __future__ import annotations

import itertools

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldlake.operators import meta, segments, vector
from foldlake.plans import catalog, metrics
from foldlake.sources import binary

quick = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
interval = st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(0, 12)).map(lambda x: (x[0], x[1], x[1] + x[2]))


@quick
@given(st.lists(interval, min_size=1, max_size=30))
def test_merged_segments_cover_the_same_places(spark, rows):
    df = spark.createDataFrame(rows, "k int, lo int, hi int")
    places = lambda rs: {(k, i) for k, lo, hi in rs for i in range(lo, hi + 1)}
    got = [tuple(r) for r in segments.merged(df, "k").collect()]
    assert places(got) == places(rows) and {tuple(r) for r in segments.residues(df, "k").collect()} == places(rows)
    for k in {r[0] for r in got}:
        own = sorted(r[1:] for r in got if r[0] == k)
        assert all(a[1] + 1 < b[0] for a, b in zip(own, own[1:], strict=False))


@quick
@given(st.lists(st.sampled_from(["a", "b", None]), min_size=1, max_size=40))
def test_runs_are_maximal(spark, values):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "k int, i int, v string")
    want, at = [], 0
    for v, group in itertools.groupby(values):
        n = len(list(group))
        if v is not None:
            want.append((0, v, at, at + n - 1))
        at += n
    assert sorted(tuple(r) for r in segments.runs(df, "k", "i", "v").collect()) == sorted(want)


@quick
@given(st.lists(st.booleans(), min_size=2, max_size=30))
def test_densest_window(spark, flags):
    df = spark.createDataFrame([(0, i, f) for i, f in enumerate(flags)], "k int, i int, f boolean")
    n, twice = len(flags), flags * 2
    sums = [sum(twice[r : r + n]) for r in range(n - 1)]
    best = max(range(n - 1), key=lambda r: (sums[r], -r))
    assert tuple(segments.window_densest(df, "k", "i", "f").first()) == (0, best, sums[best])


@quick
@given(st.lists(st.integers(1, 60), min_size=1, max_size=40))
def test_greedy_shards(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "row long, s long")
    shard, used, want = 0, 0, []
    for s in sizes:
        if used and used + s > 100:
            shard, used = shard + 1, 0
        used += s
        want.append(shard)
    assert [r.shard for r in meta.greedy_shards(df, "row", "s", 100).orderBy("row").collect()] == want


def test_tops_are_prefixes_and_batches_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-4, 5, (60, 5)).astype(float)
    db = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scored = vector.dual_scores(db, x[3].tolist())
    five, nine = ([r.vec_id for r in vector.ranked(scored, k, "score_ord").collect()] for k in (5, 9))
    assert nine[:5] == five
    want = sorted((int(q), r + 1, int(d)) for q in range(0, 60, 7) for r, d in enumerate(sorted(range(60), key=lambda d: (-x[q] @ x[d], d))[:4]))
    got = vector.top_k_batch(db, db.where("vec_id % 7 = 0"), 4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == want
    pairs = {(r.query_id, r.vec_id) for r in vector.partners(db, 20.0).collect()}
    assert pairs == {(a, b) for a in range(60) for b in range(60) if a != b and x[a] @ x[b] >= 20}


def test_quantised_scan_equals_decoded_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (40, 8))
    q = rng.uniform(-1, 1, 8)
    lo, step = -1.0, 2 / 255
    db = vector.quantise(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 8, lo, step)
    for r in vector.scan_codes(db, q.tolist(), lo, step).collect():
        assert abs(r.score - (1 + (lo + step * np.array(r.code)) @ q) / 2) < 1e-12


def test_binary_shards_must_be_whole(spark):
    import pytest

    good = spark.createDataFrame([("a", bytes(range(32))), ("b", b"")], "shard string, content binary")
    assert binary.fixed_rows(good, binary.MAP_RECORD).count() == 2
    with pytest.raises(Exception, match="records"):
        binary.fixed_rows(spark.createDataFrame([("a", bytes(17))], good.schema), binary.MAP_RECORD).count()
    with pytest.raises(Exception, match="records"):
        binary.fixed_rows(good, binary.MAP_RECORD, spark.createDataFrame([("a", 3)], "shard string, rows long")).count()


def test_manifests_tolerate_broken_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "a",\n "n": 5, "dims": 32}')
    (tmp_path / "b.json").write_text("nothing")
    rows = catalog.read_manifests(spark, str(tmp_path)).collect()
    assert [(r.name, r.n, r.nprobe, r.fanout) for r in rows] == [("a", 5, 16, 256)]


def test_reads_are_counted(spark):
    df, seen = metrics.counted(spark.createDataFrame([("ab",), (None,), ("é",)], "t string"), "reads", "t")
    df.where(F.col("t").isNotNull()).count()
    assert seen.get == {"rows": 3, "bytes": 4}


def test_basis_codes_score_as_decoded_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 12)) @ np.diag(np.linspace(2, 0.1, 12)) + 0.3
    db = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    basis = vector.fit_basis(db, 5)
    top = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1][:, :5]
    assert np.allclose(np.abs((basis.rows * top.T).sum(axis=1)), 1, atol=1e-9)
    q = rng.standard_normal(12)
    for r in vector.scan_basis(vector.encode(db, basis), q.tolist(), basis).collect():
        decoded = basis.mean + (basis.lo + basis.step * np.array(r.code)) @ basis.rows
        assert abs(r.score - (1 + q @ decoded) / 2) < 1e-9
        kept = basis.mean + (x[r.vec_id] - basis.mean) @ basis.rows.T @ basis.rows
        assert np.abs(decoded - kept).max() < 0.06
    cents = [(k, x[k].tolist()) for k in range(4)]
    vector.save_clusters(vector.assign_clusters(db, cents), f"{tmp_path}/c")
    near = vector.probe(spark.read.parquet(f"{tmp_path}/c"), cents, q.tolist(), 1)
    plan = near._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert near.count() == vector.probe(vector.assign_clusters(db, cents), cents, q.tolist(), 1).count()


def test_principal_axes(spark):
    from foldlake.operators import geometry

    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 3)) * [5, 2, 0.5]
    df = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(x)], "k int, i int, x double, y double, z double")
    r = geometry.principal_axes(df, "k").first()
    axes = np.array(r.axes).reshape(3, 3)
    assert np.allclose(axes @ axes.T, np.eye(3), atol=1e-9) and np.linalg.det(axes) > 0
    assert np.allclose(np.sort(x @ axes.T - (x @ axes.T).mean(axis=0), axis=0).std(axis=0), r.spread, atol=1e-9)


def test_sql_functions_equal_columns(spark):
    from foldlake.functions import expressions as X
    from foldlake.functions import sql

    sql.register(spark)
    df = spark.range(1, 400).select(F.col("id").cast("double").alias("n"))
    for name, f in (("search_scale", X.search_scale), ("final_scale", X.final_scale), ("score_cutoff", X.score_cutoff)):
        assert df.where(F.abs(F.expr(f"{name}(n)") - f(F.col("n"))) > 1e-12).count() == 0
    assert spark.sql("select similarity(0.5D), half_up(-0.5D), is_permutation_candidate(0.95D, 0.5D), field_value(0D, 2D)").first()[:] == (0.75, 0, True, 255)


def test_pieces_of_long_chains_have_keys_of_their_own(spark, tmp_path):
    from foldlake.functions import expressions as X
    from foldlake.queries import geometry, structures

    label = F.when(F.col("id") < 2900, 0).otherwise(1)
    rows = spark.range(2905).select(F.col("id").alias("vec_id"), label.alias("label"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.sin(k * 7 + F.col("id"))).alias("embedding"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    for found, key, size in ((geometry._pieces(spark, str(tmp_path)), "chain", 240), (structures._pieces(spark, str(tmp_path)), "piece", 60)):
        counts = found.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("i").alias("own")).collect()
        assert len(counts) == -(-2900 * 21 // size) + -(-5 * 21 // size) and all(r.n == r.own <= size for r in counts)
    numbers = spark.range(-3, 3).select(F.col("id").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(2100))).alias("k"))
    key = lambda k: X.piece_key(F.col("label"), k, 1000)
    assert numbers.where(X.next_piece(key(F.col("k")), 1000) != key(F.col("k") + 1)).count() == 0
    assert numbers.select(key(F.col("k")).alias("key")).distinct().count() == numbers.count()
    assert numbers.where((F.col("k") < 1000) & (key(F.col("k")) != F.col("label") * 1000 + F.col("k"))).count() == 0
