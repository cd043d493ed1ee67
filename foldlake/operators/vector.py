"""Vector search: single and batch scans, dual scores, quantised codes, clusters and neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X

LANE_ROWS = 16384
#: Scores that a task holds at a time.
BLOCK_SCORES = 1 << 20
#: How near a cutoff the sums of a matrix product may be wrong about.
ROUNDING = 1e-9


def ranked(scored: DataFrame, k: int, key: str, row: str = "vec_id", floor: float | None = None) -> DataFrame:
    """The ``k`` rows of the largest ``key``, ties to the smaller row; with ``floor`` only larger ones."""
    rows = scored if floor is None else scored.where(F.col(key) > floor)
    return rows.orderBy(F.desc(key), row).limit(k)


def dual_scores(db: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """``db`` with score_ord, score_inv and delta against one query vector.

    score_inv compares the sorted components, so it doesn't see their order.
    """
    plain = X.similarity(X.dot_with(F.col(vector), query))
    unordered = X.similarity(X.dot_with(F.array_sort(F.col(vector)), sorted(query)))
    return db.withColumn("score_inv", unordered).withColumn("score_ord", plain).withColumn("delta", F.col("score_inv") - F.col("score_ord"))


def union_of_tops(scored: DataFrame, n: int, keys: Sequence[str] = ("score_inv", "score_ord", "delta"), row: str = "vec_id") -> DataFrame:
    """The tops by each key in turn; a row stands where it came first. Adds rank, the place in that union."""
    parts = []
    for place, key in enumerate(keys):
        top = ranked(scored, n, key, row).withColumn("_list", F.lit(place))
        within = Window.partitionBy("_list").orderBy(F.desc(key), row)
        parts.append(top.withColumn("_pos", F.row_number().over(within)))
    tops = parts[0]
    for part in parts[1:]:
        tops = tops.unionByName(part)
    first = Window.partitionBy(row).orderBy("_list", "_pos")
    kept = tops.withColumn("_first", F.row_number().over(first)).where("_first = 1")
    # at most n rows for each key meet here
    order = Window.orderBy("_list", "_pos")
    return kept.withColumn("rank", F.row_number().over(order)).drop("_first", "_list", "_pos")


def pinned(hits: DataFrame, order_by: str, most: int, pin: Column, descending: bool = True) -> DataFrame:
    """The first ``most`` rows by a column, ties by rank, and any pinned row with its true place."""
    key = F.desc(order_by) if descending else F.asc(order_by)
    return hits.withColumn("place", F.row_number().over(Window.orderBy(key, "rank"))).where((F.col("place") <= most) | pin)


def blocked(db: DataFrame, queries: DataFrame, pick: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], vector: str = "embedding", row: str = "vec_id") -> DataFrame:
    """(query_id, vec_id, score): inner products of every query with every row, reduced in place.

    Both sides are dealt to a grid of lanes of about LANE_ROWS rows; ``pick`` gets the scores of
    some queries of a block, query ids, row ids (ascending) and both sides' vectors, and returns the positions
    (query, row) worth keeping.  Vectors travel as they are stored, and a task holds BLOCK_SCORES
    scores whatever the tables' size.
    """
    lanes = max(1, -(-db.count() // LANE_ROWS))
    groups = max(1, -(-queries.count() // LANE_ROWS))

    def dealt(df: DataFrame, n: int, own: str, other: str, m: int) -> DataFrame:
        copies = F.sequence(F.lit(0), F.lit(m - 1))
        return df.select(F.col(row).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(row), F.lit(n)).cast("int").alias(own), F.explode(copies).alias(other))

    def cell(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(q):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        d = d.sort_values("id", kind="stable")
        a, b = np.stack(q["v"].to_numpy()), np.stack(d["v"].to_numpy()).astype(np.float64)
        qid, did = q["id"].to_numpy(), d["id"].to_numpy()
        out, each = [], max(1, BLOCK_SCORES // len(b))
        for lo in range(0, len(a), each):
            own = a[lo : lo + each].astype(np.float64)
            scores = own @ b.T
            i, j = pick(scores, qid[lo : lo + each], did, own, b)
            out.append(pd.DataFrame({"query_id": qid[lo : lo + each][i], "vec_id": did[j], "score": scores[i, j]}))
        return pd.concat(out, ignore_index=True)

    left = dealt(db, lanes, "lane", "part", groups).groupBy("lane", "part")
    right = dealt(queries, groups, "part", "lane", lanes).groupBy("lane", "part")
    return left.cogroup(right).applyInPandas(cell, "query_id long, vec_id long, score double")


def top_k_batch(db: DataFrame, queries: DataFrame, k: int, exclude_self: bool = False, vector: str = "embedding", row: str = "vec_id") -> DataFrame:
    """The ``k`` best rows of each query by inner product: (query_id, rank, vec_id, score).

    A block leaves at most ``k`` rows a query, whatever number of copies score alike.  A matrix product gives
    copies scores of different last digits, so what may be among the best is summed again in the
    order of the components.
    """

    def pick(scores: np.ndarray, qid: np.ndarray, did: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if exclude_self:
            lo, hi = np.searchsorted(did, qid), np.searchsorted(did, qid, side="right")
            for r in np.flatnonzero(hi > lo):
                scores[r, lo[r] : hi[r]] = -np.inf
        near = np.full(len(scores), -np.inf)
        if scores.shape[1] > k:
            bar = np.partition(scores, -k, axis=1)[:, -k]
            near = bar - ROUNDING * np.maximum(1, np.abs(bar))
        kept = (scores >= near[:, None]) & (scores > -np.inf)
        crowded = np.flatnonzero(np.count_nonzero(kept, axis=1) > k)
        columns = np.ascontiguousarray(b.T) if len(crowded) else b.T
        for r in crowded:
            exact = np.zeros(len(b))
            for x, column in zip(a[r], columns, strict=True):
                exact += x * column
            exact[~kept[r]] = -np.inf
            bar = np.partition(exact, -k)[-k]
            above, level = exact > bar, np.flatnonzero(exact == bar)
            above[level[: k - np.count_nonzero(above)]] = True
            kept[r] = above
        i, j = np.nonzero(kept)
        scores[i, j] = _in_turn(a[i], b[j])
        return i, j

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = blocked(db, queries, pick, vector, row)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _in_turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last as SQL does."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _two_sum(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x + y rounded, and what the rounding left."""
    s = x + y
    z = s - x
    return s, (x - (s - z)) + (y - z)


def _fused(x: np.ndarray, y: np.ndarray, s: np.ndarray) -> np.ndarray:
    """x * y + s rounded once; the rest of the sum is rounded to odd first, so that the last rounding is right."""
    halves = [(c - (c - v), v - (c - (c - v))) for v, c in ((x, x * 134217729.0), (y, y * 134217729.0))]
    (xh, xl), (yh, yl) = halves
    p = x * y
    t, low = _two_sum(s, ((xh * yh - p) + xh * yl + xl * yh) + xl * yl)
    v, high = _two_sum(p, t)
    rest, left = _two_sum(low, high)
    even = (rest.view(np.int64) & 1) == 0
    rest = np.where((left != 0) & even, np.nextafter(rest, np.where(left > 0, np.inf, -np.inf)), rest)
    return v + rest


def _as_sql(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` of ``a`` and ``j`` of ``b`` to the digit of DuckDB's list_dot_product: in turn, a product and its sum rounded once."""
    total = np.zeros(len(i))
    for k in range(a.shape[1]):
        total = _fused(a[i, k], b[j, k], total)
    return total


def partners(db: DataFrame, cutoff: float, vector: str = "embedding", row: str = "vec_id", cosine: bool = False) -> DataFrame:
    """Ordered pairs of different rows with an inner product (or ``cosine``) of at least ``cutoff``: (query_id, vec_id, score).

    A score within ROUNDING of the cutoff is summed again as SQL does, its lengths too: codes of
    few levels meet a cutoff exactly, and there the roundings of the sum decide.
    """

    def lengths(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        own, back = np.unique(at, return_inverse=True)
        return np.sqrt(_as_sql(x, x, own, own))[back]

    def pick(scores: np.ndarray, qid: np.ndarray, did: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if cosine:
            long, other = np.sqrt(_in_turn(a, a)), np.sqrt(_in_turn(b, b))
            scores /= np.maximum(long, 1e-12)[:, None]
            scores /= np.maximum(other, 1e-12)
        i, j = np.nonzero((scores >= cutoff - ROUNDING) & (qid[:, None] != did[None, :]))
        near = np.flatnonzero(scores[i, j] <= cutoff + ROUNDING)
        exact = _as_sql(a, b, i[near], j[near])
        if cosine and len(near):
            exact /= np.maximum(lengths(a, i[near]) * lengths(b, j[near]), 1e-24)
        scores[i[near], j[near]] = exact
        kept = scores[i, j] >= cutoff
        return i[kept], j[kept]

    return blocked(db, db, pick, vector, row)


def quantise(db: DataFrame, dims: int, lo: float, step: float, vector: str = "embedding") -> DataFrame:
    """``db`` with code: the first ``dims`` components as levels of 0 to 255."""
    part = F.slice(vector, 1, dims)
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), X.half_up((x.cast("double") - lo) / step))).cast("smallint")
    return db.withColumn("code", F.transform(part, level))


def scan_codes(codes: DataFrame, query: Sequence[float], lo: float, step: float) -> DataFrame:
    """score of every code against a query without decoding: bias + sum of weight x code."""
    weights = [q * step / 2 for q in query]
    bias = (1 + sum(q * lo for q in query)) / 2
    return codes.withColumn("score", F.lit(bias) + X.dot_with(F.col("code"), weights))


@dataclass
class Basis:
    """A linear code: components about a mean, and the range of each as levels of one byte."""

    mean: np.ndarray
    rows: np.ndarray
    lo: np.ndarray
    step: np.ndarray

    def weights(self, query: Sequence[float]) -> tuple[float, list[float]]:
        """Bias and weights with which codes score as (1 + query . decoded) / 2."""
        q = np.asarray(query, dtype=np.float64)
        z = self.rows @ q
        return float((1 + q @ self.mean + z @ self.lo) / 2), (z * self.step / 2).tolist()


def fit_basis(db: DataFrame, dims: int, vector: str = "embedding") -> Basis:
    """The ``dims`` leading principal components of all vectors, and the range of each over them.

    Tasks reduce each batch to one matrix of sums; Spark adds these up element by element, so
    the driver sees a matrix of the vectors' width, whatever their number.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])

    parts = db.where(F.col(vector).isNotNull()).select(vector).mapInArrow(sums, "m array<double>")
    flat = parts.select(F.posexplode("m").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    m = np.array([r["v"] for r in flat])
    width = int(round(len(m) ** 0.5))
    m = m.reshape(width, width)
    mean = m[0, 1:] / m[0, 0]
    vectors = np.linalg.eigh(m[1:, 1:] / m[0, 0] - np.outer(mean, mean))[1][:, ::-1][:, :dims].T
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    basis = Basis(mean, vectors, np.zeros(len(vectors)), np.ones(len(vectors)))
    ends = project(db, basis, vector).select(F.posexplode("projected").alias("at", "v")).groupBy("at").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("at").collect()
    lo, hi = (np.array([r[c] for r in ends]) for c in ("lo", "hi"))
    return Basis(mean, vectors, lo, np.maximum(hi - lo, 1e-12) / 255)


def project(db: DataFrame, basis: Basis, vector: str = "embedding") -> DataFrame:
    """``db`` with projected: the components of each vector about the mean."""
    mean, rows = basis.mean, basis.rows.T

    @F.pandas_udf("array<double>")
    def components(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()).astype(np.float64) - mean) @ rows) if len(v) else [], dtype=object)

    return db.withColumn("projected", components(vector))


def encode(db: DataFrame, basis: Basis, vector: str = "embedding") -> DataFrame:
    """``db`` with code: the components as levels of 0 to 255."""
    lo, step = (F.array(*[F.lit(float(x)) for x in v]) for v in (basis.lo, basis.step))
    level = F.zip_with(F.zip_with("projected", lo, lambda x, a: x - a), step, lambda x, s: F.greatest(F.lit(0), F.least(F.lit(255), X.half_up(x / s))).cast("smallint"))
    return project(db, basis, vector).withColumn("code", level).drop("projected")


def scan_basis(codes: DataFrame, query: Sequence[float], basis: Basis) -> DataFrame:
    """``codes`` with score against a query, without decoding."""
    bias, weights = basis.weights(query)
    return codes.withColumn("score", F.lit(bias) + X.dot_with(F.col("code"), weights))


def save_clusters(clustered: DataFrame, path: str) -> None:
    """Writes one folder for each cluster, so that a probe reads only those it names."""
    clustered.repartition("cluster").sortWithinPartitions("cluster").write.mode("overwrite").partitionBy("cluster").parquet(path)


def _in_blocks(v: pd.Series, columns: int) -> Iterator[np.ndarray]:
    """The vectors of a batch, as many together as have BLOCK_SCORES scores with ``columns`` others."""
    each = max(1, BLOCK_SCORES // columns)
    for lo in range(0, len(v), each):
        yield np.stack(v.to_numpy()[lo : lo + each]).astype(np.float64)


def assign_clusters(db: DataFrame, centroids: Sequence[tuple[int, Sequence[float]]], vector: str = "embedding") -> DataFrame:
    """``db`` with cluster: the centroid of the largest inner product, ties to the first given.

    A few matrix products for each Arrow batch; the centroids are a fixed list and travel with the
    task.
    """
    names = np.array([k for k, _ in centroids], dtype=np.int64)
    matrix = np.array([v for _, v in centroids], dtype=np.float64).T

    @F.pandas_udf("long")
    def nearest(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="int64")
        return pd.Series(np.concatenate([names[np.argmax(x @ matrix, axis=1)] for x in _in_blocks(v, matrix.shape[1])]))

    return db.withColumn("cluster", nearest(vector))


def fit_clusters(db: DataFrame, clusters: int, sample: int = 20_000, turns: int = 20, vector: str = "embedding", row: str = "vec_id") -> list[tuple[int, list[float]]]:
    """Centroids of length 1 by spherical k-means on at most ``sample`` rows, the first by a hash of their number."""
    rows = db.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(row), row).limit(sample).select(vector).toPandas()
    if not len(rows):
        return []
    x = np.stack(rows[vector].to_numpy()).astype(np.float64)
    c = x[:clusters].copy()
    for _ in range(turns):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 0, sums / np.maximum(length, 1e-12), c)
    return [(k, v.tolist()) for k, v in enumerate(c)]


def cluster_places(exact: DataFrame, clustered: DataFrame, centroids: Sequence[tuple[int, Sequence[float]]], queries: DataFrame, vector: str = "embedding", row: str = "vec_id") -> DataFrame:
    """(query_id, place): of each row of ``exact`` (query_id, ``row``), how many clusters a query probes until it meets that row's."""
    at = {c: k for k, (c, _) in enumerate(centroids)}
    matrix = np.array([v for _, v in centroids], dtype=np.float64).T

    @F.pandas_udf("array<int>")
    def places(v: pd.Series, met: pd.Series) -> pd.Series:
        out: list[np.ndarray] = []
        for x in _in_blocks(v, len(at)):
            order = np.argsort(-(x @ matrix), axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(1, len(at) + 1)[None, :], axis=1)
            own = met.to_numpy()[len(out) : len(out) + len(x)]
            out += [p[[at[c] for c in clusters]].astype(np.int32) for p, clusters in zip(place, own, strict=True)]
        return pd.Series(out, dtype=object)

    met = exact.join(clustered.select(row, "cluster"), row).groupBy("query_id").agg(F.collect_list("cluster").alias("met"))
    both = queries.select(F.col(row).alias("query_id"), F.col(vector).alias("v")).join(met, "query_id")
    return both.select("query_id", F.explode(places("v", "met")).alias("place"))


def fewest_probes(places: DataFrame, clusters: int, recall: float = 0.9) -> int:
    """The fewest of ``clusters`` to probe so that the share ``recall`` of all rows of ``places`` (place) is met."""
    seen = {r["place"]: r["n"] for r in places.groupBy("place").agg(F.count("*").alias("n")).collect()}
    total, met = sum(seen.values()), 0
    for p in range(1, clusters + 1):
        met += seen.get(p, 0)
        if met >= recall * total:
            return p
    return clusters


def probes_for(db: DataFrame, clustered: DataFrame, centroids: Sequence[tuple[int, Sequence[float]]], queries: DataFrame, k: int = 10, recall: float = 0.9, vector: str = "embedding", row: str = "vec_id") -> int:
    """The fewest clusters to probe so that ``queries`` find the share ``recall`` of their ``k`` best rows of all."""
    places = cluster_places(top_k_batch(db, queries, k, vector=vector, row=row), clustered, centroids, queries, vector, row)
    return fewest_probes(places, len(centroids), recall)


def probe(clustered: DataFrame, centroids: Sequence[tuple[int, Sequence[float]]], query: Sequence[float], nprobe: int) -> DataFrame:
    """The rows of the ``nprobe`` clusters nearest to the query: a filter on the partition column."""
    near = sorted(centroids, key=lambda c: (-float(np.dot(c[1], query)), c[0]))[:nprobe]
    return clustered.where(F.col("cluster").isin([k for k, _ in near]))


def stride_sample(db: DataFrame, row: str, n: int, target: int) -> DataFrame:
    """About ``target`` of ``n`` rows at an even stride."""
    return db.where(F.col(row) % max(1, n // target) == 0)


def within_ball(points: DataFrame, pivot: Sequence[float], radius: float, zoom: float = 1.0) -> DataFrame:
    d2 = sum((F.col(c) - F.lit(p)) ** 2 for c, p in zip("xyz", pivot, strict=True))
    return points.where(F.sqrt(d2) <= radius * 2.5 / max(1.0, zoom))


def group_focus(points: DataFrame, group: str, share: float = 0.92) -> DataFrame:
    """Centre and discrete lower percentile radius of each group: (group, n, cx, cy, cz, radius)."""
    centre = points.groupBy(group).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in "xyz"])
    d = F.sqrt(sum((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz"))
    far = points.join(centre, group).withColumn("d", d)
    place = far.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy("d")) - 1)
    return place.where(F.col("r") == F.floor(F.lit(share) * (F.col("n") - 1))).select(group, "n", "cx", "cy", "cz", F.col("d").alias("radius"))
