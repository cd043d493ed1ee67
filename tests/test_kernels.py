"""Kernels against plain versions and invariants, and structure texts in odd cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldlake.functions import expressions as X
from foldlake.operators import align, domains, embed, geometry, meta, segments
from foldlake.sources import coordinates, structures
from foldlake.streaming import verdicts


def walk(n, seed=0):
    rng = np.random.default_rng(seed)
    steps = rng.standard_normal((n, 3))
    return np.cumsum(3.8 * steps / np.linalg.norm(steps, axis=1, keepdims=True), axis=0)


def turned(x, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((3, 3)))
    q[:, 0] *= np.sign(np.linalg.det(q))
    return x @ q.T + np.array([3.0, -2.0, 7.0])


def points(spark, x, chain=0):
    return spark.createDataFrame([(chain, i, *map(float, p)) for i, p in enumerate(x)], "chain int, i int, x double, y double, z double")


def test_mirror_images_do_not_superpose():
    x = walk(40)
    assert align.rmsd(x, x * np.array([1, 1, -1])) > 1


def test_two_blobs_are_two_domains():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 6, (60, 3)), rng.normal(0, 6, (60, 3)) + 40])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    i, j = np.nonzero((d < 8) & (d > 0))
    label = domains.labels_of(domains.Graph.of(120, i, j, np.ones(len(i))), [0.08])[0]
    assert label[:60].max() == 0 and label[60:].min() == 1


def test_short_runs_join_their_neighbours():
    w = np.zeros((150, 150))
    for k in range(149):
        w[k, k + 1] = w[k + 1, k] = 2
    w[60:70, 100:140] = w[100:140, 60:70].T + 1
    label = np.array([0] * 60 + [1] * 10 + [0] * 20 + [2] * 60)
    got = domains.absorbed(domains.Graph.dense(np.maximum(w, w.T)), label)
    assert got[:90].max() == 0 or got[60] == 2
    assert set(np.unique(domains.absorbed(domains.Graph.dense(np.zeros((90, 90))), np.array([0] * 50 + [1] * 40)))) == {0, 1}


def test_spectrum_counts_blobs_and_ends_are_trimmed():
    w = np.kron(np.eye(3), np.ones((50, 50))) + 1e-3
    assert domains.eigengap(domains.Graph.dense(w)) == 3
    loose = np.zeros((80, 80))
    loose[10:, 10:] = 1
    got = domains.trimmed(domains.Graph.dense(loose), np.zeros(80, dtype=int), 3)
    assert (got[:10] == -1).all() and (got[10:] == 0).all()


def test_cut_profile_equals_direct_sums(spark):
    x = walk(110, 7)
    p = points(spark, x)
    edges = geometry.soft_contacts(p, "chain").collect()
    w = np.zeros((110, 110))
    for e in edges:
        w[e.i, e.j] = e.w
    assert np.allclose(w, w.T)
    for r in geometry.cut_profile(geometry.soft_contacts(p, "chain"), "chain", p.groupBy("chain").agg(F.count("*").alias("n"))).collect():
        k = r.k
        if min(k, 110 - k) < 40:
            assert r.ncut is None
        else:
            cut = w[:k, k:].sum()
            assert abs(r.ncut - cut / w[:k].sum() - cut / w[k:].sum()) < 1e-9


def test_contacts_equal_all_pairs(spark):
    x = walk(80, 9)
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    got = {(r.i, r.j) for r in geometry.contacts(points(spark, x), "chain", 10.0).collect()}
    assert got == set(zip(*np.nonzero(d2 <= 100), strict=True))


def test_smoothing_sees_its_own_edits(spark):
    def plain(s):
        a = list(s)
        for i in range(len(a) - 2):
            if a[i] in "HE" and a[i + 1] != a[i] and a[i + 2] == a[i]:
                a[i + 1] = a[i]
        for i, c in enumerate(a):
            if c in "HE" and (i == 0 or a[i - 1] != c) and (i + 1 == len(a) or a[i + 1] != c):
                a[i] = "C"
        return "".join(a)

    rng = np.random.default_rng(4)
    rows = ["".join(rng.choice(list("HETC"), n)) for n in [0, 1, 2, 3, 4, *rng.integers(5, 40, 60)]]
    df = spark.createDataFrame([(r,) for r in rows], "s string").select("s", geometry.smoothed(F.col("s")).alias("t"))
    assert all(r.t == plain(r.s) for r in df.collect())


def test_embedding_ignores_rigid_motion(spark):
    x = walk(50, 11)
    both = points(spark, x, 0).union(points(spark, turned(x), 1)).union(points(spark, x[:3], 2))
    got = {r.chain: np.array(r.embedding) for r in embed.embed(both, "chain", embed.seeded()).collect()}
    assert set(got) == {0, 1} and np.allclose(got[0], got[1], atol=1e-4) and abs(np.linalg.norm(got[0]) - 1) < 1e-6


def test_weights_load_and_are_counted():
    shapes = embed.layout()
    assert len(shapes) == 58 and sum(int(np.prod(s)) for s in shapes.values()) == 1063680
    data = np.arange(1063680, dtype="<f2").tobytes()
    assert set(embed.load(data)) == set(shapes)
    with pytest.raises(ValueError):
        embed.load(data[:-2])
    with pytest.raises(ValueError):
        embed.load(data + b"\0\0")


def test_packed_coordinates_round_trip():
    book = coordinates.step_book()
    for n in (0, 1, 3, 4, 50):
        x = walk(n, n) if n else np.zeros((0, 3))
        if n == 50:
            x[30:] += 20
        back = coordinates.decode([coordinates.encode(x, book), coordinates.encode(walk(9), book)], book)
        assert back[0].shape == x.shape and (n == 0 or np.linalg.norm(back[0] - x, axis=1).max() < 0.6)
    straight = np.array([[3.8 * k, 0, 0] for k in range(10)])
    assert np.linalg.norm(coordinates.decode([coordinates.encode(straight, book)], book)[0] - straight, axis=1).max() < 0.6


PDB = """HEADER
MODRES 1ABC XXX A    3  ALA
ATOM      1  N   ALA A   1       0.000   0.000   0.000
ATOM      2  CA  ALA A   1       1.000   0.000   0.000
ATOM      3  CA AALA A   2       2.000   0.000   0.000
ATOM      4  CA BALA A   2       2.500   0.000   0.000
HETATM    5  CA  XXX A   3       3.000   0.000   0.000
HETATM    6 CA    CA A   4       9.000   0.000   0.000
HETATM    7  CA  YYY A   5       9.000   0.000   0.000
ATOM      8  CA  GLY A  52       4.000   0.000   0.000
ATOM      9  CA  GLY A  52A      5.000   0.000   0.000
ATOM     10  CA  QQQ A  53       9.000   0.000   0.000
ATOM     11  CA  GLY B   1       6.000   0.000   0.000
HETATM   12  CA  MSE A  54       7.0 junk0.000   0.000
ENDMDL
ATOM     13  CA  GLY A  99       8.000   0.000   0.000
"""

CIF = """data_x
loop_
_pdbx_struct_mod_residue.id
_pdbx_struct_mod_residue.label_comp_id
_pdbx_struct_mod_residue.parent_comp_id
1 XXX ALA
#
loop_
_atom_site.group_PDB
_atom_site.label_atom_id
_atom_site.label_alt_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
_atom_site.auth_seq_id
_atom_site.pdbx_PDB_ins_code
_atom_site.pdbx_PDB_model_num
ATOM "CA" . QQQ A 1 1.0 0 0 11 ? 1
ATOM "C A" . ALA A 1 9.0 0 0 11 ? 1
ATOM CA B ALA A 2 9.0 0 0 12 ? 1
ATOM CA A ALA A 2 2.0 0 0 12 ? 1
HETATM CA . XXX A 3 3.0 0 0 13 B 1
HETATM CA . YYY A 4 9.0 0 0 14 ? 1
HETATM CA . MSE A . 9.0 0 0 15 ? 1
ATOM CA . ALA A 1 9.0 0 0 11 ? 2
#
"""


def test_pdb_cases(spark):
    df = spark.createDataFrame([("a", PDB), ("none", ""), ("null", None)], "structure_id string, text string")
    rows = structures.residues_pdb(df).orderBy("chain", "i").collect()
    assert [(r.chain, r.i, r.seq, r.x) for r in rows] == [("A", 0, "1", 1.0), ("A", 1, "2", 2.0), ("A", 2, "3", 3.0), ("A", 3, "52", 4.0), ("A", 4, "52A", 5.0), ("A", 5, "54", 7.0), ("B", 0, "1", 6.0)]
    assert {r.chain for r in structures.chosen_chain(structures.residues_pdb(df)).collect()} == {"A"}


def test_mmcif_cases(spark):
    df = spark.createDataFrame([("a", CIF)], "structure_id string, text string")
    assert [(r.seq, r.x) for r in structures.residues_mmcif(df).orderBy("i").collect()] == [("11", 1.0), ("12", 2.0), ("13B", 3.0)]
    assert {r.structure_id for r in structures.residues(df.union(spark.createDataFrame([("b", PDB)], df.schema))).collect()} == {"a", "b"}


def test_files_and_plain_coordinates(spark, tmp_path):
    (tmp_path / "w.xyz").write_text("0 0 0\n\n 1.5 2 -3e1 \n")
    found = structures.residues_xyz(structures.read_structures(spark, str(tmp_path))).orderBy("i").collect()
    assert [(r.structure_id, r.i, r.x, r.y, r.z) for r in found] == [("w", 0, 0.0, 0.0, 0.0), ("w", 1, 1.5, 2.0, -30.0)]


def test_packed_ids(spark):
    df = spark.createDataFrame([("P12345", 3), ("A0A0B4J2F0", 255), ("000000", 0)], "a string, k int")
    packed = X.pack_id(F.col("a"), F.col("k"))
    assert [(r.a, r.k) for r in df.collect()] == [tuple(r) for r in df.select(X.unpack_accession(packed), X.unpack_index(packed)).collect()]


def test_locate_and_offsets_with_gaps(spark):
    rows = spark.createDataFrame([(r,) for r in (0, 4, 5, 9, 70000, 200000)], "row long")
    shards = spark.createDataFrame([("a", 5), ("b", 9), ("c", 150000)], "name string, row0 long")
    got = {r.row: r.shard.name if r.shard else None for r in meta.locate(rows, shards).collect()}
    assert got == {0: None, 4: None, 5: "a", 9: "b", 70000: "b", 200000: "c"}
    sized = spark.range(10000).select(F.col("id").alias("row"), (F.col("id") % 7).alias("s"))
    total = 0
    for r in meta.prefix_offsets(sized, "row", "s").orderBy("row").collect():
        assert r.offset == total
        total += r.s


def test_largest_gap_falls_back(spark):
    seg = spark.createDataFrame([(1, 0, 9), (2, 2, 3), (2, 12, 13)], "k int, lo int, hi int")
    n = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, n int")
    got = {r.k: (r.lo, r.hi) for r in segments.largest_gap(seg, n, "k").collect()}
    assert got == {1: (4, 6), 2: (4, 11), 3: (0, 29)}


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:20:00", "a", 2.0), (1, "2024-01-01 03:00:00", "b", 4.0)], "user_id long, ts string, event_type string, value double")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = verdicts.windowed_counts(stream, late="10 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("windows").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    hits = spark.createDataFrame([("q", 1, 0.2), ("q", 2, 0.4), ("q", 2, 0.9), ("r", 1, None)], "request string, generation int, tm double").withColumn("tm_cp", F.col("tm"))
    hits.write.parquet(f"{tmp_path}/hits")
    incoming = spark.readStream.schema(hits.schema).parquet(f"{tmp_path}/hits")
    verdicts.judge(incoming, align.verified, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert sorted((r.request, r.tm) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("q", 0.9), ("r", None)]
