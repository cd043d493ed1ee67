"""What a reviewer found on larger tables: one small test for each."""

from __future__ import annotations

import math
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.operators import align, atlas, domains, geometry, paths, segments, superpose, vector
from foldlake.plans import views
from foldlake.queries import ORACLE, QUERIES, structures
from foldlake.sources import sharded

from .test_queries import plain

DATA = "/root/testdata/sf0.001"


def test_contacts_equal_all_pairs(spark):
    rng = random.Random(4)
    grid = [k * 2.5 for k in range(-6, 7)]
    points = [(c, i, *(rng.choice(grid) if c else rng.uniform(-30, 30) for _ in "xyz")) for c in (0, 1) for i in range(250)]
    df = spark.createDataFrame(points, "chain int, i int, x double, y double, z double")
    got = sorted(map(tuple, geometry.contacts(df, "chain", 10.0).collect()))
    near = lambda p, q: sum((a - b) ** 2 for a, b in zip(p[2:], q[2:], strict=True))
    want = sorted((p[0], p[1], q[1], near(p, q)) for p in points for q in points if p[0] == q[0] and near(p, q) <= 100)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))


@pytest.mark.parametrize("name", ["graph_average", "contact_messages", "embed_batch", "residue_contribution", "subset_embeddings", "domain_averaged", "domain_consensus", "domain_rescored"])
def test_copies_of_points_are_not_broadcast(spark, name):
    """The copies outgrow the estimate of a small file many times, so no side that holds them may pass through the driver."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    copied = [line for line in plan.splitlines() if "Join" in line and "_key" in line]
    assert copied and all("SortMergeJoin" in line for line in copied)


def equals_sql(spark, name, folder, *tables):
    con = pytest.importorskip("duckdb").connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) <= 2e-4 for x, y in zip(a, b, strict=True)), (a, b)


@pytest.fixture(scope="module")
def long_chain(spark, tmp_path_factory):
    """Three chains, the first of over 1,000 pieces of 60 residues, so that the SQL's label * 1000 + number is shared."""
    folder = tmp_path_factory.mktemp("long")
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 0.125) for _ in range(64)], 0 if k < 2900 else 1 if k < 2930 else 3) for k in range(2935)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["sharded_rows", "align_report", "align_round_trip", "coordinates_roundtrip", "kabsch_rmsd", "mixed_formats", "mmcif_roundtrip", "pdb_roundtrip", "tm_given", "tm_self"])
def test_pieces_are_named_as_in_sql(spark, long_chain, name):
    equals_sql(spark, name, long_chain, "embeddings")


def test_pdb_texts_hold_far_coordinates(spark, tmp_path):
    rows = [(k, [-0.125] * 64, 0) for k in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    equals_sql(spark, "pdb_roundtrip", tmp_path, "embeddings")


def test_shards_step_over_rows_far_apart(spark, tmp_path):
    rows = [(k + (at << 40), bytes([at]) * (k % 5)) for at in (0, 1, 7) for k in range(0, 200, 3)]
    sharded.write(spark.createDataFrame(rows, "row long, record binary"), f"{tmp_path}/s", 2)
    spark.dataSource.register(sharded.ShardedRecords)
    found = spark.read.format("sharded_records").load(f"{tmp_path}/s")
    assert sorted((r.row, bytes(r.record)) for r in found.collect()) == sorted(r for r in rows if r[1])


def test_accessions_of_large_keys(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (1, 15000, 274_877, 274_878, 900_000, 5_000_000)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    equals_sql(spark, "id_pack_unpack", tmp_path, "customer")


def test_map_records_of_many_suppliers(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (1, 999, 11_000, 40_001, 65_536, 400_003)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    equals_sql(spark, "map_records", tmp_path, "supplier")


def test_a_task_holds_few_scores(spark):
    db = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))

    def pick(scores, qid, did, *_):
        assert scores.size <= 1 << 20
        return scores.argmax(axis=1) * 0, scores.argmax(axis=1)

    assert vector.blocked(db, db, pick).count() == 3000


def test_partners_at_the_cutoff_are_those_of_sql(spark):
    rng = random.Random(2)
    rows = [(k, [float(rng.choice((-3, -1, 1, 3))) for _ in range(8)]) for k in range(150)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(i, j) for i, a in rows for j, b in rows if i != j and dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))) >= 0.5}
    found = vector.partners(spark.createDataFrame(rows, "vec_id long, v array<double>"), 0.5, vector="v", cosine=True)
    assert {(r.query_id, r.vec_id) for r in found.collect()} == want


def test_partners_of_codes_at_the_cutoff_are_those_of_sql(spark, tmp_path):
    """F1 of round 4: codes of few levels, whose cosines meet the cutoff exactly; SQL rounds a product and its sum once."""
    rng = random.Random(3)
    rows = [(k, [rng.choice((126, 127, 128, 129)) * 2 / 255 - 1 for _ in range(32)], k % 3) for k in range(700)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    equals_sql(spark, "map_partner_counts", tmp_path, "embeddings")


def test_a_sum_of_products_is_rounded_once():
    rng = random.Random(5)
    x, y, s = (np.array([rng.uniform(-1, 1) * 10 ** rng.randint(-9, 2) for _ in range(5000)]) for _ in range(3))
    s[::2] = -x[::2] * y[::2] * (1 + s[::2] * 1e-15)
    exact = [float(Fraction(a) * Fraction(b) + Fraction(c)) for a, b, c in zip(x.tolist(), y.tolist(), s.tolist(), strict=True)]
    assert vector._fused(x, y, s).tolist() == exact


def _chain(rng, n):
    steps = rng.standard_normal((n, 3))
    return np.cumsum(3.8 * steps / np.linalg.norm(steps, axis=1, keepdims=True), axis=0)


def test_a_group_of_shorter_pairs_is_matched_in_a_block_of_longer_ones(monkeypatch):
    """F2 of round 4: a block is matched in groups, and one of shorter pairs only is narrower than the block."""
    rng = np.random.default_rng(6)
    pairs = [(x := _chain(rng, n), y := x[::-1] + rng.standard_normal((n, 3)), align.kinds(x), align.kinds(y)) for n in (12, 12, 12, 30)]
    whole = align.solved(align.Block.of(pairs))
    monkeypatch.setattr(paths, "HELD", 1)
    for a, b in zip(align.solved(align.Block.of(pairs)), whole, strict=True):
        assert abs(a["tm"] - b["tm"]) < 1e-9 and a["i"].tolist() == b["i"].tolist()


@pytest.mark.parametrize("name", ["align_report", "tm_self"])
def test_pieces_of_one_name_are_aligned_apart(spark, long_chain, name, monkeypatch):
    """F2 and F3 of round 4: as one piece they take the square of their number."""
    longest, dealt = [], align.dealt
    monkeypatch.setattr(align, "dealt", lambda pairs, *a, **k: longest.append(pairs.agg(F.max(F.size("query"))).first()[0] / 3) or dealt(pairs, *a, **k))
    QUERIES[name](spark, str(long_chain))
    assert len(longest) == 1 and longest[0] < 60 + 2 * 4


def test_chains_that_meet_are_not_searched(monkeypatch):
    """F3 of round 4: a score that nothing can exceed ends the search of its pair, and only of that."""
    rng = np.random.default_rng(7)
    x, other = _chain(rng, 40), _chain(rng, 30)
    turn = np.linalg.qr(rng.standard_normal((3, 3)))[0]
    y = x[5:35] @ (turn * np.sign(np.linalg.det(turn))).T + 9
    pair = lambda a, b: (a, b, align.kinds(a), align.kinds(b))
    alone, searched, search = align.one(x, other), [], align._searched
    monkeypatch.setattr(align, "_searched", lambda block, *a: searched.append(len(block.n)) or search(block, *a))
    met, apart, back = align.solved(align.Block.of([pair(x, y), pair(x, other), pair(y, x)]))
    assert searched == [1] and abs(apart["tm"] - alone["tm"]) < 1e-9
    assert (met["i"] - met["j"]).tolist() == [5] * 30 and (back["j"] - back["i"]).tolist() == [5] * 30
    assert abs(met["tm"] - 1) < 1e-9 and abs(back["tm"] - 0.75) < 1e-9 and abs(met["tm_query"] - 0.75) < 1e-9 and met["rmsd"] < 1e-6
    assert np.abs(x[5:35] @ met["rotation"].reshape(3, 3).T + met["shift"] - y).max() < 1e-6
    for got, chains in ((met, (x, y)), (back, (y, x))):
        block = align.Block.of([pair(*chains)])
        want = search(block, align.thread(block, 5), True)[0]
        assert all(abs(got[k] - want[k]) < 1e-6 for k in ("tm", "tm_query", "rmsd", "scale")) and got["i"].tolist() == want["i"].tolist() and got["j"].tolist() == want["j"].tolist()


def test_votes_are_dealt_once(spark):
    plan = QUERIES["coassociation"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_edges_of_a_chain_are_weighed_in_blocks(spark):
    points = spark.range(5000).select(F.lit(0).alias("chain"), F.col("id").cast("int").alias("i"), *[(F.sin(F.col("id") * k) * 9 + F.col("id") / 40).alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])
    vectors = points.where("i % 7 <> 0").select("chain", "i", F.array("x", "y", "z").alias("v"))
    edges = geometry.soft_contacts(points, "chain")
    found = domains.learned_contacts(edges, vectors, "chain")
    assert "_block" in found._jdf.queryExecution().analyzed().toString()
    v = {r.i: r.v for r in vectors.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    before, after = ({(r.i, r.j): r.w for r in df.collect()} for df in (edges, found))
    assert before.keys() == after.keys() and len(before) > 10000
    for (i, j), w in before.items():
        if abs(i - j) != 1 and i in v and j in v:
            w *= ((1 + dot(v[i], v[j]) / math.sqrt(dot(v[i], v[i]) * dot(v[j], v[j]))) / 2) ** 6
        assert abs(after[i, j] - w) < 1e-9


def joins(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin")


def test_contacts_are_searched_once(spark):
    """Several distances come from one search, and labels of both ends come along with it."""
    assert joins(QUERIES["graph_average"](spark, DATA)) == 1
    assert joins(QUERIES["strongest_partner"](spark, DATA)) == 1
    points = spark.range(60).select(F.lit(0).alias("chain"), F.col("id").cast("int").alias("i"), *[(F.sin(F.col("id") * k) * 9).alias(c) for k, c in ((1, "x"), (2, "y"), (3, "z"))])
    assert joins(domains.perturbed_contacts(points, "chain", 3)) == 1
    assert joins(geometry.soft_contacts(points, "chain", 7.6, 8.0, 8.4)) == 1
    mean = {(r.i, r.j): r.w for r in geometry.soft_contacts(points, "chain", 7.6, 8.0, 8.4).collect()}
    each = [{(r.i, r.j): r.w for r in geometry.soft_contacts(points, "chain", d).collect()} for d in (7.6, 8.0, 8.4)]
    assert mean.keys() == set().union(*each) and all(abs(w - sum(e.get(k, 0) for e in each) / 3) < 1e-12 for k, w in mean.items())


def test_points_of_a_graph_are_not_broadcast(spark):
    """Neither the residues nor their degrees pass through the driver."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plan = QUERIES["embed_batch"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "i#" in line]


def test_parses_of_a_consensus_are_made_once(spark):
    plan = QUERIES["domain_consensus"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1
    votes = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (0, 1), (0, 3), (1, 4), (1, 4), (1, 2)], "key int, k int")
    assert sorted(map(tuple, segments.of_modal_count(votes, "key", "k").collect())) == [(0, 1), (0, 1), (1, 4), (1, 4)]


def test_a_ladder_is_one_row_a_rung(spark):
    plan = QUERIES["ladder_plateaus"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "collect_list" not in plan


def test_spectrum_of_the_whole_matrix(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    for parts in (1, 3):
        table = np.zeros((90, 90))
        for k in range(parts):
            own = slice(k * 30, k * 30 + 90 // parts)
            block = rng.random((own.stop - own.start,) * 2) * (rng.random((own.stop - own.start,) * 2) < 0.2)
            table[own, own] = np.triu(block, 1) + np.triu(block, 1).T
        graph = domains.Graph.dense(table)
        monkeypatch.setattr(domains, "WHOLE", 512)
        monkeypatch.setattr(domains, "leading", None)
        whole = domains.spectrum(graph, 8)
        monkeypatch.undo()
        monkeypatch.setattr(domains, "WHOLE", 0)
        assert np.allclose(whole, domains.spectrum(graph, 8), atol=1e-8)
        monkeypatch.undo()


def test_nearest_of_dense_and_far_points(spark, monkeypatch):
    """Cells get finer with the targets; copies, ties, lone points and what is no number come out as over all pairs."""
    rng = random.Random(9)
    spot = lambda s: tuple(round(rng.gauss(0, s), 3) for _ in "xyz")
    rows = [(k, *spot(0.01 if k % 3 else 0.2)) for k in range(500)] + [(500 + k, 0.001, 0.002, 0.0) for k in range(50)] + [(550, float("nan"), 0.0, 0.0), (551, None, 0.0, 0.0)]
    a, b = (spark.createDataFrame(x, "p long, x double, y double, z double") for x in (rows[::2], rows[1::2]))
    near = lambda p, q: round(sum((s - t) ** 2 for s, t in zip(p[1:], q[1:], strict=True)), 9)
    real = [r for r in rows if r[1] is not None and r[1] == r[1]]
    ids = {r[0] for r in rows[::2]}
    want = {}
    for p in (r for r in real if r[0] in ids):
        d2, t = min((near(p, q), q[0]) for q in real if q[0] not in ids)
        if d2 <= 0.0064:
            want[p[0]] = (t, d2)
    monkeypatch.setattr(atlas, "CELL_TARGETS", 4)
    got = {r.p: (r.t, r.d2) for r in atlas.nearest(a, b.withColumnRenamed("p", "t"), 0.08, "p", "t").collect()}
    assert got == want and 200 < len(want) < len(ids)


def test_rotations_are_those_of_singular_values():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(5)
    h = rng.standard_normal((3000, 3, 3)) * 10.0 ** rng.integers(-6, 7, (3000, 1, 1))
    # reflections, equal values, planes and lines, and nothing at all
    h[:200, 2] = h[:200, 0] + 1e-9 * h[:200, 2]
    h[200:300] = np.eye(3)
    h[300:400] = np.diag([1.0, 1.0, -1.0])
    h[400:500] = h[400:500, :, :1] * h[400:500, :1, :]
    h[500] = 0
    got, want = superpose.rotations(h), superpose._by_svd(h)
    assert np.allclose(got @ got.transpose(0, 2, 1), np.eye(3), atol=1e-12) and np.allclose(np.linalg.det(got), 1)
    trace = lambda r: (r * h).sum(axis=(1, 2)) / np.maximum(np.linalg.norm(h, axis=(1, 2)), 1e-300)
    assert np.allclose(trace(got), trace(want), atol=1e-12)
    assert np.abs(got[501:] - want[501:]).max() < 1e-9


def test_an_alignment_is_computed_once(spark):
    """Its digits depend on the pairs beside it, so the way back takes the alignment of the way there; pieces of one name stay apart."""
    found = QUERIES["align_round_trip"](spark, DATA)
    assert "MapInArrow" not in found._jdf.queryExecution().sparkPlan().toString()


def test_round_trips_grow_with_the_pieces(spark, long_chain, monkeypatch):
    """A name that several chains share is no longer chain, and a piece of too few residues joins another of its name."""
    sizes = []

    def seen(pairs, *args):
        sizes.extend((r.n, r.pieces) for r in pairs.groupBy((F.size("query") / 3).alias("n")).agg(F.count("*").alias("pieces")).collect())
        return pairs

    monkeypatch.setattr(structures.A, "dealt", seen)
    points = [(n, i, float(i), float(i * i % 7), float(n)) for n, k in ((1000, 60), ((1 << 40), 3), (2000, 3), ((1 << 40) + 1000, 3), (3000, 2)) for i in range(k)]
    odd = spark.createDataFrame(points, "piece long, i int, x double, y double, z double")
    monkeypatch.setattr(structures, "_pieces", lambda *_: odd)
    got = sorted(map(tuple, structures.align_round_trip(spark, long_chain).collect()))
    assert got == [(1000, 63, 0.0), (2000, 6, 0.0)]
    assert sorted(sizes) == [(2.0, 1), (6.0, 1), (63.0, 1)]
    monkeypatch.undo()
    sizes.clear()
    monkeypatch.setattr(structures.A, "dealt", seen)
    structures.align_round_trip(spark, long_chain)
    assert max(n for n, _ in sizes) <= 63


def test_long_sums_keep_their_digits(spark):
    """The coordinates of a long chain are the sums of its steps to the last digits, so they round as those of SQL."""
    rows = [(k, [0.1, 0.2 + k % 3 / 8, -0.3] * 21 + [0.0], 0) for k in range(1500)]
    found = views.trace(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {r.i: (r.x, r.y, r.z) for r in found.where("i % 997 = 0").collect()}
    single = lambda v: struct.unpack("f", struct.pack("f", v))[0]
    steps = []
    for _, v, _ in rows:
        x, y, z = map(single, v[:3])
        m = math.sqrt(x * x + y * y + z * z)
        steps += [(x / m * 3.8, y / m * 3.8, z / m * 3.8)] * 21
    assert len(got) == 32
    for i, point in got.items():
        for k in range(3):
            exact = math.fsum(s[k] for s in steps[: i + 1])
            assert abs(point[k] - exact) <= math.ulp(exact)


def test_a_block_leaves_few_rows_of_many_copies(spark, monkeypatch):
    """Copies score alike and go by their number, and no more than k of them leave a block."""
    np = pytest.importorskip("numpy")
    found = []
    monkeypatch.setattr(vector, "blocked", lambda db, queries, pick, *args: found.append(pick) or spark.range(0).selectExpr("id query_id", "id vec_id", "0D score"))
    vector.top_k_batch(None, None, 5)
    v = np.random.default_rng(1).standard_normal((2, 64))
    b = np.concatenate([np.tile(v[:1], (1001, 1)), -v[:1], np.tile(v[:1], (1002, 1))])
    scores = v @ b.T
    scores[:, 900:] *= 1 + 1e-15
    i, j = found[0](scores, np.array([0, 1]), np.arange(len(b)), v, b)
    assert i.tolist() == [0] * 5 + [1] * 5
    assert j.tolist()[:5] == [0, 1, 2, 3, 4]
    assert len(set(scores[0, j[:5]])) == 1


def test_copies_are_neighbours_by_their_number(spark):
    rng = random.Random(6)
    kinds = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(3)]
    rows = [(k, kinds[k % 3]) for k in range(999)]
    db = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    got = {}
    for r in vector.top_k_batch(db, db.where("vec_id % 20 = 0"), 5, exclude_self=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert len(got) == 50
    for q, best in got.items():
        assert [v for _, v in sorted(best)] == [v for v in range(q % 3, 999, 3) if v != q][:5]


def test_probed_clusters_are_not_listed(spark, monkeypatch):
    """A query's place of a cluster is looked up in blocks of few scores; no list of a query's probes is made."""
    blocked, calls = vector.blocked, []
    monkeypatch.setattr(vector, "blocked", lambda *args: calls.append(1) or blocked(*args))
    found = QUERIES["ivf_fitted"](spark, DATA).agg(F.sum("found").alias("found"), F.sum("n").alias("n")).first()
    assert len(calls) == 1 and found.found >= 0.9 * found.n
    monkeypatch.setattr(vector, "BLOCK_SCORES", 7)
    db = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    cents = [(5, [1.0, 0.0]), (3, [0.0, 1.0]), (9, [-1.0, 0.0]), (1, [0.0, -1.0])]
    clustered = vector.assign_clusters(db, cents)
    of = {r.vec_id: (r.cluster, r.embedding) for r in clustered.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    order = {k: [c for c, _ in sorted(cents, key=lambda c: -dot(c[1], v))] for k, (_, v) in of.items()}
    assert all(c == order[k][0] for k, (c, _) in of.items())
    exact = db.selectExpr("vec_id query_id", "(vec_id * 7 + 3) % 40 vec_id")
    got = {r.query_id: r.place for r in vector.cluster_places(exact, clustered, cents, db).collect()}
    assert got == {k: order[k].index(of[(k * 7 + 3) % 40][0]) + 1 for k in range(40)}
