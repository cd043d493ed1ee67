"""Queries over maps, binary records, manifests and small interval operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import atlas as U
from ..operators import geometry as G
from ..operators import segments as S
from ..operators import vector as V
from ..plans import catalog as C
from ..plans.views import SEGMENT_SQL, TRACE_SQL, event_segments, table, trace
from ..sources import binary as B
from .vector import _CODES, _DUAL, DIMS, LO, STEP, _dual, _points, _tops


def map_records(spark, d):
    s = F.col("s_suppkey")
    fields = [s * 3 - 500, s % 1000 - 100, -s, s * 7 % 65536, F.when(s % 5 == 0, (1 << 32) - 1).otherwise(s), s % 11, s % 4, F.when(s % 3 == 0, 65535).otherwise(s % 2)]
    rows = table(spark, d, "supplier").select(s.alias("k"), F.floor(s / 64).alias("shard"), F.hex(F.concat(*[B.little_endian(f, int(kind[-1])) for f, (_, kind) in zip(fields, B.WIDE_MAP_RECORD, strict=True)])).alias("h"))
    shards = rows.groupBy(F.col("shard").cast("string").alias("shard")).agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "")).alias("content"), F.count("*").alias("rows"))
    found = B.map_rows(B.fixed_rows(shards.select("shard", "content"), B.WIDE_MAP_RECORD, shards.select("shard", "rows")), B.WIDE_MAP_RECORD)
    return found.select("x", "y", "z", F.round("delta", 6).alias("delta"), "nres", "fold", "cls", "cp")


def id_list(spark, d):
    names = table(spark, d, "nation").groupBy(F.lit("ids").alias("shard")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\n").cast("binary").alias("content"))
    return B.id_lines(names).select("row", "id")


def manifest_defaults(spark, d):
    n = F.col("n_nationkey")
    text = F.when(n % 4 == 0, F.lit("{not json")).otherwise(F.concat(F.lit('{"name":"'), "n_name", F.lit('","dims":32,"n":'), (n * 100000).cast("string"), F.when(n % 2 == 0, F.lit(',"nprobe":4')).otherwise(F.lit("")), F.lit("}")))
    rows = C.manifests(table(spark, d, "nation").select(text.alias("text")))
    return C.whole_scans(rows.withColumn("clusters", F.when(F.col("n") % 200000 == 0, 1))).select("name", "n", "nprobe", "fanout", "idFormat", F.col("refused").isNotNull().alias("refused"))


def normal_codes(spark, d):
    rows = U.normal_codes(V.quantise(table(spark, d, "embeddings"), DIMS, LO, STEP), LO, STEP)
    return rows.select("vec_id", *[F.round(F.get("unit", F.lit(k)), 5).alias(f"u{k}") for k in (0, 15, 31)])


def map_partner_counts(spark, d):
    rows = V.quantise(table(spark, d, "embeddings"), DIMS, LO, STEP)
    found = V.partners(rows.select("vec_id", U.decoded("code", LO, STEP).alias("v")), 0.5, vector="v", cosine=True)
    return found.groupBy("query_id").agg(F.count("*").alias("n"))


def late_metadata(spark, d):
    hits = V.union_of_tops(_dual(spark, d).drop("label", "embedding"), 8)
    return U.late(hits.select("rank", "vec_id"), table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")


def coordinate_availability(spark, d):
    hits = V.union_of_tops(_dual(spark, d), 8).select("rank", "vec_id")
    directory = table(spark, d, "part").select(F.col("p_partkey").alias("vec_id"), F.when(F.col("p_size") > 25, F.col("p_size")).otherwise(0).alias("length"))
    return U.available(hits, directory, "vec_id").select("rank", "vec_id", "has_coords")


def subset_mask(spark, d):
    chosen = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("c_nationkey"))
    return U.subset(table(spark, d, "customer"), chosen, "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("n"))


def _cuts(spark, d):
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select((s % 10).cast("int").alias("label"), s.alias("domain"), (s * 37 % 900 + 1).cast("int").alias("lo"), (s * 37 % 900 + 1 + s % 50).cast("int").alias("hi"))


def chopping_cut(spark, d):
    residues = trace(table(spark, d, "embeddings")).withColumn("seq", F.col("i") + 1)
    return U.chopped(residues, _cuts(spark, d), "label").groupBy("label").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def first_domain(spark, d):
    residues = trace(table(spark, d, "embeddings")).select("label", "i")
    return U.first_domain(residues, _cuts(spark, d), "label")


def uncovered_residues(spark, d):
    residues = trace(table(spark, d, "embeddings")).select("label", "i")
    n = residues.groupBy("label").agg(F.count("*").alias("n"))
    covered = S.residues(_cuts(spark, d).join(n, "label"), "label", "n", n=F.col("n").cast("int")).groupBy("label").agg(F.count("*").alias("covered"))
    return n.join(covered, "label", "left").select("label", "n", F.coalesce("covered", F.lit(0)).alias("covered"), (F.col("n") - F.coalesce("covered", F.lit(0))).alias("free"))


def graph_average(spark, d):
    edges = U.averaged(trace(table(spark, d, "embeddings")), "label", (7.6, 8.0, 8.4))
    return edges.groupBy("label", "i").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("w"))


def strongest_partner(spark, d):
    points = trace(table(spark, d, "embeddings"))
    found = U.strongest(points.withColumn("piece", F.floor(F.col("i") / 50)), "label", "piece")
    return found.select("label", "piece", "other", F.round("weight", 4).alias("weight"))


def contribution_scale(spark, d):
    w = Window.partitionBy("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(U.unit_scaled(F.col("l_quantity"), w), 6).alias("share"))


def clamp_segments(spark, d):
    lo, hi = U.clamped(F.col("p_size") * 3 - 40, F.col("p_size") * 2 - 10, F.lit(80))
    return table(spark, d, "part").select("p_partkey", lo.alias("lo"), hi.alias("hi"))


def pdb_ids(spark, d):
    text = F.concat(F.lit(" "), F.lower(F.substring("c_name", -4, 4)), F.when(F.col("c_custkey") % 3 == 0, "!").otherwise(" "))
    return table(spark, d, "customer").select("c_custkey", U.pdb_id(text).alias("code"))


def nearest_point(spark, d):
    points = _points(spark, d)
    found = U.nearest(points.where("label < 5"), points.where("label >= 5").withColumnRenamed("vec_id", "to_id"), 0.08, "vec_id", "to_id")
    return found.select("vec_id", "to_id", F.round("d2", 6).alias("d2"))


def map_diagnostics(spark, d):
    return U.diagnostics(_points(spark, d), F.col("x") > 0).select("shown", "hidden", F.round("near", 6).alias("near"), F.round("far", 6).alias("far"), "front", "back")


def changed_segments(spark, d):
    own = event_segments(table(spark, d, "events")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("segments"))
    before = own.select("user_id", F.when(F.col("user_id") % 2 == 0, F.col("segments")).otherwise(F.slice("segments", 2, 1000000)).alias("segments")).where("user_id % 5 <> 0")
    return U.changed(own, before, "user_id")


def score_sums(spark, d):
    """The sum of closeness of each piece of a chain against the next one, residue by residue."""
    points = trace(table(spark, d, "embeddings")).select("label", F.floor(F.col("i") / 50).alias("piece"), (F.col("i") % 50).alias("k"), *"xyz")
    nxt = points.select("label", (F.col("piece") - 1).alias("piece"), "k", *[F.col(c).alias(f"{c}2") for c in "xyz"])
    d2 = sum((F.col(c) - F.col(f"{c}2")) ** 2 for c in "xyz")
    d0 = X.final_scale(F.lit(50))
    return points.join(nxt, ["label", "piece", "k"]).groupBy("label", "piece").agg(F.round(F.sum(1 / (1 + d2 / (d0 * d0))) / 50, 6).alias("tm"), F.count_if(d2 <= X.score_cutoff(F.lit(50)) ** 2).alias("near"))


def event_properties(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    map_records, id_list, manifest_defaults, normal_codes, map_partner_counts, late_metadata, coordinate_availability, subset_mask, chopping_cut, first_domain,
    uncovered_residues, graph_average, strongest_partner, contribution_scale, clamp_segments, pdb_ids, nearest_point, map_diagnostics, changed_segments,
    score_sums, event_properties,
)}

_POINTS = "points AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_CUTS = "cuts AS (SELECT CAST(s_suppkey % 10 AS INTEGER) AS label, s_suppkey AS domain, CAST(s_suppkey * 37 % 900 + 1 AS INTEGER) AS lo, CAST(s_suppkey * 37 % 900 + 1 + s_suppkey % 50 AS INTEGER) AS hi FROM supplier)"
_D2 = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"
_UNIT = f"{_CODES}, deco AS (SELECT vec_id, [{LO} + {STEP!r} * k FOR k IN code] AS v FROM codes), unit AS (SELECT vec_id, v, sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))) AS m FROM deco)"


def _soft(distance: float) -> str:
    lo = distance - 1
    return f"SELECT label, i, j, CASE WHEN abs(i - j) = 1 THEN 2.0 WHEN dist <= {lo} THEN 1.0 ELSE (1 + cos(pi() * (dist - {lo}) / 2)) / 2 END AS w FROM near WHERE abs(i - j) = 1 OR dist < {distance + 1}"


_NEAR = f"{TRACE_SQL}, near AS (SELECT a.label, a.i, b.i AS j, sqrt({_D2}) AS dist FROM trace AS a JOIN trace AS b ON a.label = b.label WHERE a.i <> b.i)"

ORACLE = {
    "map_records": """SELECT s_suppkey * 3 - 500 AS x, s_suppkey % 1000 - 100 AS y, -s_suppkey AS z, CASE WHEN s_suppkey * 7 % 65536 <> 65535 THEN round(s_suppkey * 7 % 65536 / 65535.0, 6) END AS delta,
        CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey END AS nres, s_suppkey % 11 AS fold, s_suppkey % 4 AS cls, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey % 2 END AS cp FROM supplier""",
    "id_list": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row, n_name AS id FROM nation",
    "manifest_defaults": """SELECT n_name AS name, CAST(n_nationkey * 100000 AS BIGINT) AS n, CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 16 END AS nprobe, 256 AS fanout, 'text' AS "idFormat",
        n_nationkey * 100000 % 200000 <> 0 AND n_nationkey * 3200000 > 8000000 AS refused FROM nation WHERE n_nationkey % 4 <> 0""",
    "normal_codes": f"WITH {_UNIT} SELECT vec_id, round(v[1] / m, 5) AS u0, round(v[16] / m, 5) AS u15, round(v[32] / m, 5) AS u31 FROM unit",
    "map_partner_counts": f"WITH {_UNIT} SELECT a.vec_id AS query_id, count(*) AS n FROM unit AS a, unit AS b WHERE a.vec_id <> b.vec_id AND list_dot_product(CAST(a.v AS DOUBLE[]), CAST(b.v AS DOUBLE[])) / (a.m * b.m) >= 0.5 GROUP BY 1",
    "late_metadata": f"WITH {_DUAL}, {_tops(8)} SELECT rank, vec_id, label FROM tops",
    "coordinate_availability": f"WITH {_DUAL}, {_tops(8)} SELECT rank, vec_id, coalesce(p_size > 25, false) AS has_coords FROM tops LEFT JOIN part ON vec_id = p_partkey",
    "subset_mask": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY c_nationkey",
    "chopping_cut": f"WITH {TRACE_SQL}, {_CUTS}, r AS (SELECT DISTINCT trace.label, trace.i + 1 AS seq FROM trace JOIN cuts ON trace.label = cuts.label AND trace.i + 1 BETWEEN lo AND hi) SELECT label, count(*) AS n, min(seq) AS first, max(seq) AS last FROM r GROUP BY label",
    "first_domain": f"WITH {TRACE_SQL}, {_CUTS} SELECT trace.label, trace.i, min(domain) AS domain FROM trace LEFT JOIN cuts ON trace.label = cuts.label AND trace.i BETWEEN lo AND hi GROUP BY 1, 2",
    "uncovered_residues": f"""WITH {TRACE_SQL}, {_CUTS}, n AS (SELECT label, count(*) AS n FROM trace GROUP BY label), c AS (SELECT label, count(*) AS covered FROM (SELECT DISTINCT trace.label, trace.i FROM trace JOIN cuts ON trace.label = cuts.label AND trace.i BETWEEN lo AND hi) AS u GROUP BY label)
        SELECT n.label, n, coalesce(covered, 0) AS covered, n - coalesce(covered, 0) AS free FROM n LEFT JOIN c ON n.label = c.label""",
    "graph_average": f"WITH {_NEAR}, e AS ({_soft(7.6)} UNION ALL {_soft(8.0)} UNION ALL {_soft(8.4)}), g AS (SELECT label, i, j, sum(w) / 3 AS w FROM e WHERE w > 0 GROUP BY label, i, j) SELECT label, i, count(*) AS n, round(sum(w), 4) AS w FROM g GROUP BY label, i",
    "strongest_partner": f"""WITH {_NEAR}, e AS ({_soft(8.0)}), s AS (SELECT label, CAST(i // 50 AS BIGINT) AS piece, CAST(j // 50 AS BIGINT) AS other, round(sum(w), 9) AS weight FROM e WHERE i // 50 <> j // 50 GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY label, piece ORDER BY weight DESC, other) AS r FROM s WHERE weight > 0) SELECT label, piece, other, round(weight, 4) AS weight FROM r WHERE r = 1""",
    "contribution_scale": "SELECT l_orderkey, l_linenumber, round(CASE WHEN max(l_quantity) OVER w > min(l_quantity) OVER w THEN (l_quantity - min(l_quantity) OVER w) / (max(l_quantity) OVER w - min(l_quantity) OVER w) ELSE 0.5 END, 6) AS share FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)",
    "clamp_segments": "SELECT p_partkey, greatest(0, least(79, least(p_size * 3 - 40, p_size * 2 - 10))) AS lo, greatest(0, least(79, greatest(p_size * 3 - 40, p_size * 2 - 10))) AS hi FROM part",
    "pdb_ids": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND regexp_matches(upper(right(c_name, 4)), '^[0-9A-Z]{4}$') THEN upper(right(c_name, 4)) END AS code FROM customer",
    "nearest_point": f"""WITH {_POINTS}, p AS (SELECT a.vec_id, b.vec_id AS to_id, round({_D2}, 9) AS d2 FROM points AS a, points AS b WHERE a.label < 5 AND b.label >= 5 AND {_D2} <= 0.0064),
        r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, to_id) AS r FROM p) SELECT vec_id, to_id, round(d2, 6) AS d2 FROM r WHERE r = 1""",
    "map_diagnostics": f"""WITH {_POINTS} SELECT count(*) FILTER (WHERE x > 0) AS shown, count(*) FILTER (WHERE NOT x > 0) AS hidden, round(min(z), 6) AS near, round(max(z), 6) AS far,
        (SELECT vec_id FROM points ORDER BY z, vec_id LIMIT 1) AS front, (SELECT vec_id FROM points ORDER BY z DESC, vec_id LIMIT 1) AS back FROM points""",
    "changed_segments": f"WITH {SEGMENT_SQL} SELECT user_id, user_id % 2 <> 0 OR user_id % 5 = 0 AS dirty FROM seg GROUP BY user_id",
    "score_sums": f"""WITH {TRACE_SQL}, p AS (SELECT label, CAST(i // 50 AS BIGINT) AS piece, i % 50 AS k, x, y, z FROM trace), s AS (SELECT 1.24 * cbrt(35) - 1.8 AS d0, 1.5 * pow(50, 0.3) + 3.5 AS d8)
        SELECT a.label, a.piece, round(sum(1 / (1 + ({_D2}) / (d0 * d0))) / 50, 6) AS tm, count(*) FILTER (WHERE {_D2} <= d8 * d8) AS near FROM p AS a JOIN p AS b ON a.label = b.label AND a.piece + 1 = b.piece AND a.k = b.k, s GROUP BY 1, 2""",
    "event_properties": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
}
