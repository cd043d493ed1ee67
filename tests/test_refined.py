"""Operators that SQL does not hold: against plain versions of their rules."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.operators import embed, geometry, meta, vector
from foldlake.queries import QUERIES
from foldlake.streaming import verdicts

DATA = "/root/testdata/sf0.001"


def plain_smooth(s):
    s = list(s)
    for k in range(len(s) - 2):
        if s[k] in "HE" and s[k] == s[k + 2] != s[k + 1]:
            s[k + 1] = s[k]
    for k, c in enumerate(s):
        left, right = s[k - 1] if k else "", s[k + 1] if k + 1 < len(s) else ""
        if c in "HE" and left != c and right != c:
            s[k] = "C"
    return "".join(s)


def test_smoothing_equals_the_plain_rule(spark):
    rng = random.Random(3)
    texts = ["", "H", "HE", "HCH", "HEHE", "HCHCH", "EHEHEHE"] + ["".join(rng.choice("HECT") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", geometry.smoothed(F.col("s")).alias("out")).collect()
    assert all(r.out == plain_smooth(r.s) for r in rows)


@pytest.mark.parametrize("capacity", [1, 7, 40])
def test_shards_equal_a_plain_walk(spark, capacity):
    rng = random.Random(capacity)
    sizes = [rng.choice([0, 1, 2, 5, 9, 60]) for _ in range(300)]
    df = spark.createDataFrame([(10 + 3 * k, s) for k, s in enumerate(sizes)], "row long, size long")
    shard, used, want = 0, 0, {}
    for k, s in enumerate(sizes):
        if used and used + s > capacity:
            shard, used = shard + 1, 0
        used += s
        want[10 + 3 * k] = shard
    assert {r.row: r.shard for r in meta.greedy_shards(df, "row", "size", capacity).collect()} == want
    assert meta.greedy_shards(df.limit(0), "row", "size", capacity).count() == 0


def test_fitted_clusters_reach_their_recall(spark):
    rows = QUERIES["ivf_fitted"](spark, DATA).collect()
    assert sum(r.found for r in rows) >= 0.88 * sum(r.n for r in rows)
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 1, (12, 16))
    data = [(i, (x := centers[i % 12] + rng.normal(0, 0.1, 16)) / np.linalg.norm(x)) for i in range(600)]
    db = spark.createDataFrame([(i, x.tolist()) for i, x in data], "vec_id long, embedding array<double>")
    cents = vector.fit_clusters(db, 24)
    clustered = vector.assign_clusters(db, cents)
    assert vector.probes_for(db, clustered, cents, db.where("vec_id % 20 = 0")) <= 8


def test_fixed_clusters_reach_the_recall(spark):
    found = QUERIES["ivf_recall"](spark, DATA).collect()
    assert sum(r.found for r in found) >= 0.9 * 10 * len(found)


def test_pooling_a_whole_chain_is_its_embedding(spark):
    rng = np.random.default_rng(5)
    points = []
    for c, n in enumerate((30, 18)):
        steps = rng.normal(0, 1, (n, 3))
        xyz = np.cumsum(3.8 * steps / np.linalg.norm(steps, axis=1, keepdims=True), axis=0)
        points += [(c, i, *map(float, p)) for i, p in enumerate(xyz)]
    df = spark.createDataFrame(points, "chain int, i int, x double, y double, z double")
    weights = embed.seeded()
    vectors = embed.residue_vectors(df, "chain", weights)
    members = df.select("chain", "i", F.lit("all").alias("part")).union(df.where("i < 3").select("chain", "i", F.lit("few").alias("part")))
    got = {(r.chain, r.part): r for r in embed.pooled(vectors, members, "chain", "part", weights).collect()}
    for r in embed.embed(df, "chain", weights).collect():
        assert np.allclose(got[r.chain, "all"].embedding, r.embedding, atol=1e-5)
        assert got[r.chain, "few"].too_short and got[r.chain, "few"].embedding is None
    norms = embed.message_norms(df, "chain", weights).collect()
    near = geometry.contacts(df, "chain", 10.0).count()
    assert len(norms) == embed.LAYERS * near
    by = {(r.chain, r.layer, r.i, r.j): r.norm for r in norms}
    assert any(abs(v - by[c, k, j, i]) > 1e-6 for (c, k, i, j), v in by.items())


def test_a_generation_stays_superseded_in_later_batches(spark, tmp_path):
    batches = [[(1, 1, "a"), (2, 5, "b")], [(1, 2, "c"), (1, 1, "late"), (2, 5, "d")], [(1, 1, "later"), (1, 2, "e"), (2, 4, "old")]]
    stream = spark.readStream.schema("request long, generation long, hit string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "request long, generation long, hit string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for k in range(len(batches)):
        for f in (tmp_path / "in" / str(k)).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    query = verdicts.newest_only(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.hit for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c", "d", "e"]
