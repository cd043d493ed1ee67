"""Queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import vector as V
from ..plans.lineage import cut
from ..plans.views import table

DIMS, LO, STEP = 32, -1.0, 2 / 255
QUERY = 7
#: Of 16 clusters; vectors without structure are found in most of them.  Recall of the ten best is about 0.93.
PROBES = 13


def _db(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _query(db: DataFrame, vec_id: int = QUERY) -> list[float]:
    return [float(x) for x in db.where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def _dual(spark: SparkSession, d: str) -> DataFrame:
    db = _db(spark, d)
    return V.dual_scores(db, _query(db))


_Q = f"(SELECT embedding FROM embeddings WHERE vec_id = {QUERY})"
_DUAL = f"""
dual AS (
  SELECT vec_id, label, (1 + list_dot_product(CAST(list_sort(e.embedding) AS DOUBLE[]), CAST(list_sort(q.embedding) AS DOUBLE[]))) / 2 AS score_inv,
         (1 + list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) / 2 AS score_ord
  FROM embeddings AS e, {_Q} AS q
),
scored AS (SELECT *, score_inv - score_ord AS delta FROM dual)"""


def topk_cosine(spark, d):
    return V.ranked(_dual(spark, d), 10, "score_ord").select("vec_id", _r("score_ord"))


def topk_min_similarity(spark, d):
    return V.ranked(_dual(spark, d).where("score_ord >= 0.8"), 100, "score_ord").select("vec_id", _r("score_ord"))


def topk_batch_queries(spark, d):
    db = _db(spark, d)
    return V.top_k_batch(db, db.where("vec_id % 20 = 0"), 5).select("query_id", "rank", "vec_id", F.round(X.similarity(F.col("score")), 6).alias("score"))


def dual_score_delta(spark, d):
    return _dual(spark, d).select("vec_id", _r("score_inv"), _r("score_ord"), _r("delta"))


def union_of_tops(spark, d):
    hits = V.union_of_tops(_dual(spark, d), 5)
    flag = X.is_permutation_candidate(F.col("score_inv"), F.col("score_ord"), 0.99, 0.45)
    return hits.select("rank", "vec_id", _r("score_inv"), _r("score_ord"), _r("delta"), flag.alias("is_cp"))


def pinned_table(spark, d):
    hits = V.union_of_tops(_dual(spark, d), 10)
    return V.pinned(hits, "delta", 5, F.col("vec_id") == QUERY).select("place", "rank", "vec_id", _r("delta"))


def cp_candidates(spark, d):
    flag = X.is_permutation_candidate(F.col("score_inv"), F.col("score_ord"), 0.99, 0.45)
    return _dual(spark, d).where(flag).select("vec_id", _r("score_inv"), _r("score_ord"))


def cp_total(spark, d):
    wide, tight = (X.is_permutation_candidate(F.col("score_inv"), F.col("score_ord"), *x) for x in ((0.9, 0.6), (0.99, 0.45)))
    return _dual(spark, d).agg(F.count_if(wide).alias("cp_default"), F.count_if(tight).alias("cp_tight"), F.count("*").alias("scanned"))


def score_tint(spark, d):
    v = F.col("score_ord")
    return _dual(spark, d).select("vec_id", F.round(X.log_closeness(v), 6).alias("closeness"), X.signed(F.col("delta")).alias("shown"))


def score_plane_bins(spark, d):
    bins = [F.floor(F.col(c) * 20).cast("int").alias(f"{c}_bin") for c in ("score_inv", "score_ord")]
    return _dual(spark, d).groupBy(*bins).agg(F.count("*").alias("n"))


def stride_sample(spark, d):
    db = _db(spark, d)
    return V.stride_sample(db, "vec_id", db.count(), 200).select("vec_id", "label")


def _codes(spark, d):
    return V.quantise(_db(spark, d), DIMS, LO, STEP)


def quantised_scan(spark, d):
    db = _db(spark, d)
    return V.ranked(V.scan_codes(_codes(spark, d), _query(db)[:DIMS], LO, STEP), 10, "score").select("vec_id", _r("score"))


def quantised_vs_exact(spark, d):
    db = _db(spark, d)
    q = _query(db)[:DIMS]
    exact = X.similarity(X.dot_with(F.col("embedding"), q))
    gap = F.abs(F.col("score") - exact)
    return V.scan_codes(_codes(spark, d), q, LO, STEP).agg(F.round(F.max(gap), 6).alias("worst"), F.round(F.avg(gap), 6).alias("mean"))


_CODES = f"""
codes AS (
  SELECT vec_id, embedding, [greatest(0, least(255, floor((CAST(x AS DOUBLE) - ({LO})) / {STEP!r} + 0.5))) FOR x IN embedding[1:{DIMS}]] AS code FROM embeddings
),
scan AS (
  SELECT c.vec_id, c.embedding, q.embedding AS query,
         (1 + list_dot_product(CAST([{LO} + {STEP!r} * k FOR k IN code] AS DOUBLE[]), CAST(q.embedding[1:{DIMS}] AS DOUBLE[]))) / 2 AS score
  FROM codes AS c, {_Q} AS q
)"""


def pca_scan(spark, d):
    db = _db(spark, d)
    basis = V.fit_basis(db, DIMS)
    return V.ranked(V.scan_basis(V.encode(db, basis), _query(db), basis), 10, "score").select("vec_id", F.round("score", 4).alias("score"))


def pca_layout(spark, d):
    db = _db(spark, d)
    found = V.project(db, V.fit_basis(db, 3))
    return found.select("vec_id", *[F.round(F.get("projected", F.lit(k)), 4).alias(c) for k, c in enumerate("xyz")])


def _centroids(db: DataFrame, n: int = 16) -> list[tuple[int, list[float]]]:
    return [(r[0], [float(x) for x in r[1]]) for r in db.where(F.col("vec_id") < n).select("vec_id", "embedding").orderBy("vec_id").collect()]


def ivf_assign(spark, d):
    db = _db(spark, d)
    return V.assign_clusters(db, _centroids(db)).groupBy("cluster").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


def ivf_probe_topk(spark, d):
    db = _db(spark, d)
    cents, q = _centroids(db), _query(db)
    rows = V.probe(V.assign_clusters(db, cents), cents, q, PROBES)
    return V.ranked(V.dual_scores(rows, q), 10, "score_ord").select("vec_id", "cluster", _r("score_ord"))


def ivf_recall(spark, d):
    db = _db(spark, d)
    cents = _centroids(db)
    clustered = V.assign_clusters(db, cents).select("vec_id", "cluster")
    queries = db.where("vec_id % 20 = 0")
    exact = V.top_k_batch(db, queries, 10)
    near = V.top_k_batch(db.where("vec_id < 16"), queries, PROBES).select("query_id", F.col("vec_id").alias("cluster"))
    met = exact.join(clustered, "vec_id").join(near, ["query_id", "cluster"], "left_semi")
    return met.groupBy("query_id").agg(F.count("*").alias("found"))


def ivf_fitted(spark, d):
    """Each probed query's share of its ten best rows; as many clusters are probed as a recall of 0.9 takes."""
    db = _db(spark, d)
    n = db.count()
    cents = V.fit_clusters(db, max(1, int(n**0.5)))
    clustered = V.assign_clusters(db, cents).select("vec_id", "cluster", "embedding")
    queries = db.where("vec_id % 20 = 0")
    # all queries tell the recall: some that the centroids were fitted on would tell too much
    place = cut(V.cluster_places(V.top_k_batch(db, queries, 10), clustered, cents, queries))
    probes = V.fewest_probes(place, len(cents))
    return place.groupBy("query_id").agg(F.count_if(F.col("place") <= probes).alias("found"), F.count("*").alias("n")).withColumn("probes", F.lit(probes))


def tint_ramps(spark, d):
    rows = _dual(spark, d)
    return rows.select("vec_id", F.round(X.sharp_ramp(F.col("score_ord"), 0.6), 5).alias("score_tint"), F.round(X.delta_ramp(F.col("delta"), 0.2), 5).alias("delta_tint"))


def knn12(spark, d):
    db = _db(spark, d)
    return V.top_k_batch(db, db, 12, exclude_self=True).select("query_id", "rank", "vec_id", _r("score"))


def kth_neighbour(spark, d):
    db = _db(spark, d)
    far = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))
    return V.top_k_batch(db, db, 12, exclude_self=True).where("rank = 12").select("query_id", F.round(far, 4).alias("distance"))


def partners_above(spark, d):
    return V.partners(_db(spark, d), 0.45).select("query_id", "vec_id", _r("score"))


def partner_counts(spark, d):
    db = _db(spark, d)
    n = V.partners(db, 0.5).groupBy("query_id").agg(F.count("*").alias("n"))
    return db.select("vec_id").join(n, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n"))


def _points(spark, d):
    return _db(spark, d).select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")])


def group_centroid_p92(spark, d):
    return V.group_focus(_points(spark, d), "label").select("label", "n", *[_r(c) for c in ("cx", "cy", "cz", "radius")])


def crop_ball(spark, d):
    return V.within_ball(_points(spark, d), (0.05, 0.0, -0.05), 0.08, 1.5).select("vec_id", _r("x"), _r("y"), _r("z"))


_PAIRS = """
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings AS a, embeddings AS b WHERE a.vec_id <> b.vec_id
)"""
_NEAR = f"{_PAIRS}, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)"
_IVF = """
cent AS (SELECT vec_id AS cluster, embedding FROM embeddings WHERE vec_id < 16),
ranked AS (
  SELECT e.vec_id, c.cluster, row_number() OVER (PARTITION BY e.vec_id ORDER BY list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) DESC, c.cluster) AS r
  FROM embeddings AS e, cent AS c
),
assigned AS (SELECT vec_id, cluster FROM ranked WHERE r = 1)"""
_XYZ = "points AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def _tops(n: int) -> str:
    return f"""
listed AS (
  SELECT vec_id, 0 AS l, row_number() OVER (ORDER BY score_inv DESC, vec_id) AS p FROM scored
  UNION ALL SELECT vec_id, 1, row_number() OVER (ORDER BY score_ord DESC, vec_id) FROM scored
  UNION ALL SELECT vec_id, 2, row_number() OVER (ORDER BY delta DESC, vec_id) FROM scored
),
firsts AS (SELECT vec_id, min(l * 1000 + p) AS spot FROM listed WHERE p <= {n} GROUP BY vec_id),
tops AS (SELECT CAST(row_number() OVER (ORDER BY spot) AS INTEGER) AS rank, s.* FROM firsts JOIN scored AS s ON firsts.vec_id = s.vec_id)"""


QUERIES = {f.__name__: f for f in (
    union_of_tops, topk_cosine, topk_min_similarity, topk_batch_queries, dual_score_delta, pinned_table, cp_candidates, cp_total, score_tint,
    score_plane_bins, stride_sample, quantised_scan, quantised_vs_exact, pca_scan, pca_layout, ivf_assign, ivf_probe_topk, ivf_recall, ivf_fitted, tint_ramps, knn12, kth_neighbour,
    partners_above, partner_counts, group_centroid_p92, crop_ball,
)}

ORACLE = {
    "union_of_tops": f"WITH {_DUAL}, {_tops(5)} SELECT rank, vec_id, round(score_inv, 6) AS score_inv, round(score_ord, 6) AS score_ord, round(delta, 6) + 0.0 AS delta, score_ord < 0.45 AND score_inv > 0.99 AS is_cp FROM tops",
    "topk_cosine": f"WITH {_DUAL} SELECT vec_id, round(score_ord, 6) AS score_ord FROM scored ORDER BY scored.score_ord DESC, vec_id LIMIT 10",
    "topk_min_similarity": f"WITH {_DUAL} SELECT vec_id, round(score_ord, 6) AS score_ord FROM scored WHERE scored.score_ord >= 0.8 ORDER BY scored.score_ord DESC, vec_id LIMIT 100",
    "topk_batch_queries": """WITH p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, (1 + list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) / 2 AS score
        FROM embeddings AS a, embeddings AS b WHERE a.vec_id % 20 = 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
        SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "dual_score_delta": f"WITH {_DUAL} SELECT vec_id, round(score_inv, 6) AS score_inv, round(score_ord, 6) AS score_ord, round(delta, 6) + 0.0 AS delta FROM scored",
    "pinned_table": f"WITH {_DUAL}, {_tops(10)}, placed AS (SELECT *, CAST(row_number() OVER (ORDER BY delta DESC, rank) AS INTEGER) AS place FROM tops) SELECT place, rank, vec_id, round(delta, 6) + 0.0 AS delta FROM placed WHERE place <= 5 OR vec_id = {QUERY}",
    "cp_candidates": f"WITH {_DUAL} SELECT vec_id, round(score_inv, 6) AS score_inv, round(score_ord, 6) AS score_ord FROM scored WHERE scored.score_ord < 0.45 AND scored.score_inv > 0.99",
    "cp_total": f"WITH {_DUAL} SELECT count(*) FILTER (WHERE score_ord < 0.6 AND score_inv > 0.9) AS cp_default, count(*) FILTER (WHERE score_ord < 0.45 AND score_inv > 0.99) AS cp_tight, count(*) AS scanned FROM scored",
    "score_tint": f"""WITH {_DUAL} SELECT vec_id, round(log10(1 / greatest(2e-3, 1 - score_ord)) / log10(500.0), 6) AS closeness,
        CASE WHEN printf('%.2f', abs(delta)) = '0.00' THEN '0.00' WHEN delta < 0 THEN '-' || printf('%.2f', abs(delta)) ELSE '+' || printf('%.2f', abs(delta)) END AS shown FROM scored""",
    "score_plane_bins": f"WITH {_DUAL} SELECT CAST(floor(score_inv * 20) AS INTEGER) AS score_inv_bin, CAST(floor(score_ord * 20) AS INTEGER) AS score_ord_bin, count(*) AS n FROM scored GROUP BY 1, 2",
    "stride_sample": "SELECT vec_id, label FROM embeddings WHERE vec_id % greatest(1, (SELECT count(*) FROM embeddings) // 200) = 0",
    "quantised_scan": f"WITH {_CODES} SELECT vec_id, round(score, 6) AS score FROM scan ORDER BY scan.score DESC, vec_id LIMIT 10",
    "quantised_vs_exact": f"WITH {_CODES}, g AS (SELECT abs(score - (1 + list_dot_product(CAST(embedding[1:{DIMS}] AS DOUBLE[]), CAST(query[1:{DIMS}] AS DOUBLE[]))) / 2) AS gap FROM scan) SELECT round(max(gap), 6) AS worst, round(avg(gap), 6) AS mean FROM g",
    "ivf_assign": f"WITH {_IVF} SELECT cluster, count(*) AS n, min(vec_id) AS first FROM assigned GROUP BY cluster",
    "ivf_probe_topk": f"""WITH {_IVF}, {_DUAL}, near AS (SELECT cluster FROM cent, {_Q} AS q ORDER BY list_dot_product(CAST(cent.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, cluster LIMIT {PROBES})
        SELECT s.vec_id, a.cluster, round(s.score_ord, 6) AS score_ord FROM scored AS s JOIN assigned AS a ON s.vec_id = a.vec_id WHERE a.cluster IN (SELECT cluster FROM near) ORDER BY s.score_ord DESC, s.vec_id LIMIT 10""",
    "ivf_recall": f"""WITH {_IVF}, p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings AS a, embeddings AS b WHERE a.vec_id % 20 = 0),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM p),
        n AS (SELECT query_id, vec_id AS cluster, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM p WHERE vec_id < 16)
        SELECT t.query_id, count(*) AS found FROM t JOIN assigned AS a ON t.vec_id = a.vec_id JOIN n ON n.query_id = t.query_id AND n.cluster = a.cluster AND n.r <= {PROBES} WHERE t.r <= 10 GROUP BY t.query_id""",
    "tint_ramps": f"""WITH {_DUAL}, p AS (SELECT vec_id, score_ord AS v, delta AS d, log10(1 / greatest(2e-3, 1 - score_ord)) / log10(500.0) AS p, log10(1 / 0.4) / log10(500.0) AS pc FROM scored)
        SELECT vec_id, round(CASE WHEN p <= 0 THEN 0.0 WHEN v < 0.6 THEN 0.28 * (p / pc) ELSE 0.62 + 0.38 * least(1.0, (p - pc) / greatest(1e-6, 1 - pc)) END, 5) AS score_tint,
        round(CASE WHEN d <= 0 THEN 0.0 ELSE least(1.0, d / 0.8) * CASE WHEN d >= 0.2 THEN 1.0 ELSE 0.45 END END, 5) AS delta_tint FROM p""",
    "knn12": f"WITH {_NEAR} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM near WHERE rank <= 12",
    "kth_neighbour": f"WITH {_NEAR} SELECT query_id, round(sqrt(greatest(0, 2 - 2 * score)), 4) AS distance FROM near WHERE rank = 12",
    "partners_above": f"WITH {_PAIRS} SELECT query_id, vec_id, round(score, 6) AS score FROM pairs WHERE pairs.score >= 0.45",
    "partner_counts": f"WITH {_PAIRS} SELECT e.vec_id, count(p.vec_id) AS n FROM embeddings AS e LEFT JOIN (SELECT * FROM pairs WHERE score >= 0.5) AS p ON e.vec_id = p.query_id GROUP BY e.vec_id",
    "group_centroid_p92": f"""WITH {_XYZ}, c AS (SELECT label, count(*) AS n, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM points GROUP BY label),
        f AS (SELECT c.*, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS dist FROM points JOIN c ON points.label = c.label),
        o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY dist) - 1 AS r FROM f)
        SELECT label, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(dist, 6) AS radius FROM o WHERE r = floor(0.92 * (n - 1))""",
    "crop_ball": f"WITH {_XYZ} SELECT vec_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM points WHERE sqrt((points.x - 0.05) ** 2 + points.y ** 2 + (points.z + 0.05) ** 2) <= 0.08 * 2.5 / 1.5",
}
