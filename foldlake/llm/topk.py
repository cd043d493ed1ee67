"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are documents and their components are terms.

1. Order.  Each vector goes to the nearest of ``PIVOTS`` sampled ones, and rows are sorted by
   their two nearest pivots and cut into ranges of ``BLOCK`` documents.  A block keeps the
   largest and the smallest value of every term, and its forward index: the rows of values.
   The first bar of a query is its k-th score in its own block, where its likes are.
2. Bounds.  For a query the term maxima, summed with its own values, bound every score in a
   block.  Bounds meet queries on a grid of lanes of blocks and groups of queries; no forward
   index travels.  A block is alive for a group if its bound reaches the bar of a query there.
3. Scores.  The forward indexes of living blocks, and queries, go to the cells that have any.
   There blocks are scored in the order of their bounds until a bound falls below the query's
   k-th score; a bound that ties with it matters only while a smaller id may be in the block.

A task sees at most ``LANE_BLOCKS`` blocks and about ``GROUP_ROWS`` queries.  Pivots only save
work: whatever they are, the result is exact.  How much is saved depends on the vectors, and
``pruning`` measures it: where terms are spread alike over all vectors, as in noise of many
dimensions, no sum of term maxima falls below a k-th score, and every pair is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

BLOCK = 32
LANE_BLOCKS = 256
GROUP_ROWS = 4096
PIVOTS = 512
_PLACES = 8  # bits for the place in a block
EXACT = 1 << 53


def integers(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, values): floor(scale * x) of each component as a double.

    Rows whose id or vector is null or empty, or holds a null or non-finite component, are left
    out.  Rows that share an id stay rows of their own.
    """
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~bad
    return vectors.where(fit).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("values"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _largest(*parts: np.ndarray) -> list[int]:
    """The largest absolute value of each coordinate."""
    return [max(int(p[:, j].max(initial=0)) if hi else -int(p[:, j].min(initial=0)) for p in parts for hi in (0, 1)) for j in range(parts[0].shape[1])]


def _fitting(queries: np.ndarray, *rows: np.ndarray) -> type:
    """The type in which all inner products of ``queries`` with ``rows`` are exact: Python integers, if no other is."""
    limit = sum(a * b for a, b in zip(_largest(queries), _largest(*rows), strict=True))
    return np.float64 if limit < EXACT else np.int64 if limit < 1 << 63 else object


def _nearest(pivots: np.ndarray):
    """(vec_id, values, query) with length and the two pivots of the largest cosine; rows of another length have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-9)
        for batch in batches:
            values = batch.column(1)
            length = np.diff(values.offsets.to_numpy())
            first, second = np.full(len(length), -1), np.full(len(length), -1)
            own = np.flatnonzero(length == pivots.shape[1])
            if len(own):
                scores = _matrix(values.take(pa.array(own))).astype(np.float64) @ unit.T
                first[own] = scores.argmax(axis=1)
                scores[np.arange(len(own)), first[own]] = -np.inf
                second[own] = scores.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32))], [*batch.schema.names, "length", "first", "second"])

    return run


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, or the least value where there are fewer."""
    least = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(scores), least)


def _blocks(k: int):
    """Rows in order to blocks (block, length, ids, rows, most, least), with the places and the bars of the queries in them."""
    names = ["block", "length", "ids", "rows", "most", "least", "places", "bars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple[int, np.ndarray, bool]] = []

        def cut() -> pa.RecordBatch:
            nonlocal n
            ids, rows = np.array([h[0] for h in held], np.int64), np.stack([h[1] for h in held])
            places = np.flatnonzero([h[2] for h in held])
            kind = _fitting(rows[places], rows)
            scores = rows[places].astype(kind) @ rows.astype(kind).T
            own = np.ones(scores.shape, dtype=bool)
            own[np.arange(len(places)), places] = False
            bars = kth(scores[own].reshape(len(places), -1), k) if len(places) else np.zeros(0)
            bars = np.where(bars <= np.iinfo(np.int64).min, np.iinfo(np.int64).min, bars).astype(np.int64)
            parts = [ids, rows, rows.max(axis=0), rows.min(axis=0), places, bars]
            block = (part << 32) + n
            n += 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([rows.shape[1]], pa.int32()), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in parts)], names)

        for batch in batches:
            query = batch.column(2).to_numpy(zero_copy_only=False)
            for i, values, q in zip(batch.column(0).to_numpy(), batch.column(1), query, strict=True):
                row = values.values.to_numpy(zero_copy_only=False).astype(np.int64)
                if held and (len(held) == BLOCK or len(row) != len(held[0][1])):
                    yield cut()
                held.append((int(i), row, bool(q)))
        if held:
            yield cut()

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to their queries: (query, query_id, length, values, bar); query is the row's own number."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for row in batch.to_pylist():
            ids, places, bars = (np.frombuffer(row[c], np.int64) for c in ("ids", "places", "bars"))
            values = np.frombuffer(row["rows"], np.int64).reshape(len(ids), -1)
            for p, bar in zip(places, bars, strict=True):
                for x, y in zip(out, ((row["block"] << _PLACES) + int(p), int(ids[p]), row["length"], values[p].tobytes(), int(bar)), strict=True):
                    x.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()), strict=True)], ["query", "query_id", "length", "values", "bar"])


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The summed term maxima of each (query, block); rounded upwards where they exceed 63 bits."""
    kind = _fitting(queries, most, least)
    if kind is object:
        q, rows = queries.astype(np.float64), [x.astype(np.float64) for x in (most, least)]
        slack = np.abs(q) @ np.maximum(*map(np.abs, rows)).T * (4 * queries.shape[1] * np.finfo(np.float64).eps)
        return np.maximum(q, 0) @ rows[0].T + np.minimum(q, 0) @ rows[1].T + slack
    q = queries.astype(kind)
    return np.maximum(q, 0) @ most.astype(kind).T + np.minimum(q, 0) @ least.astype(kind).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of one query, ties to the smaller id."""
    if len(scores) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= bar
        scores, ids = scores[keep], ids[keep]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search(queries: np.ndarray, own: np.ndarray, bars: np.ndarray, blocks: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Each query's best (scores, ids) among ``blocks`` (number, ids, rows), and how many (query, block) pairs were scored.

    ``own`` are the numbers of the queries' own rows, which are left out.
    """
    most, least = np.stack([rows.max(axis=0) for _, _, rows in blocks]), np.stack([rows.min(axis=0) for _, _, rows in blocks])
    first = np.array([ids.min() for _, ids, _ in blocks])
    kind = _fitting(queries, most, least)
    limits, q_values = bounds(queries, most, least), queries.astype(kind)
    order = np.argsort(-limits, axis=1, kind="stable")
    found = [(np.zeros(0, kind), np.zeros(0, np.int64)) for _ in queries]
    bar = bars.astype(kind)
    bar_id = np.full(len(queries), np.iinfo(np.int64).max)
    alive, scored = np.arange(len(queries)), 0
    for turn in range(len(blocks)):
        at = order[alive, turn]
        limit = limits[alive, at]
        ok = limit >= bar[alive]  # bounds only fall from here on
        alive, at, limit = alive[ok], at[ok], limit[ok]
        if not len(alive):
            break
        tied = (limit == bar[alive]) & (first[at] > bar_id[alive])
        for b in np.unique(at[~tied]):
            q = alive[(at == b) & ~tied]
            number, ids, rows = blocks[b]
            scores = q_values[q] @ rows.astype(kind).T
            scored += len(q)
            mine = (np.int64(number) << _PLACES) + np.arange(len(ids))
            for j in np.flatnonzero((scores >= bar[q][:, None]).any(axis=1)):
                i = q[j]
                keep = (scores[j] >= bar[i]) & (mine != own[i])
                s, x = best(np.concatenate([found[i][0], scores[j][keep]]), np.concatenate([found[i][1], ids[keep]]), k)
                found[i] = (s, x)
                if len(s) == k and s[-1] >= bar[i]:
                    bar[i], bar_id[i] = s[-1], x[-1]
    return found, scored


def _numbers(column: pd.Series, shape: tuple[int, ...] = (-1,)) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64).reshape(shape) for x in column]


def _searched(vectors: DataFrame, is_query: Column, k: int, **columns) -> tuple[DataFrame, int]:
    """(query, query_id, vec_id, score, scored): the best of each cell, and on a row of its own the pairs it scored; and all pairs."""
    rows = checkpointed(integers(vectors, **columns).withColumn("query", F.coalesce(is_query, F.lit(False))))
    total = rows.count()
    lengths = rows.groupBy(F.size("values").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(1)
    sample = rows.join(F.broadcast(lengths), F.size("values") == F.col("length")).orderBy(F.xxhash64("vec_id"), "vec_id", "values").limit(PIVOTS).select("values").toArrow()
    pivots = _matrix(sample.column("values").combine_chunks()).astype(np.float64) if sample.num_rows else np.zeros((0, 0))
    lanes = max(1, -(-total // (LANE_BLOCKS * BLOCK)))
    near = rows.mapInArrow(_nearest(pivots), "vec_id long, values array<bigint>, query boolean, length int, first int, second int")
    place = ["length", "first", "second", "vec_id", "values"]
    ranges = min(lanes, 4096)
    ordered = near.repartitionByRange(ranges, *place).sortWithinPartitions(*place).select("vec_id", "values", "query")
    binary = ", ".join(f"{c} binary" for c in ("ids", "rows", "most", "least", "places", "bars"))
    blocks = checkpointed(ordered.mapInArrow(_blocks(k), f"block long, length int, {binary}"))
    # lanes are blocks that follow each other, groups the queries of ranges that do
    lane = (F.shiftright("block", 32) * F.lit(1 << 32) + F.floor(F.col("block").bitwiseAND(F.lit((1 << 32) - 1)) / LANE_BLOCKS)).alias("lane")
    blocks = blocks.select("*", lane)
    queries = checkpointed(blocks.where(F.octet_length("places") > 0).select("block", "length", "ids", "rows", "places", "bars").mapInArrow(_asked, "query long, query_id long, length int, values binary, bar long"))
    asked = queries.count()
    groups = max(1, -(-asked // GROUP_ROWS))
    queries = queries.withColumn("part", F.floor(F.shiftright("query", 32 + _PLACES) * groups / ranges))
    # lanes and groups are few and known by length; every lane meets every group of its length
    all_lanes = blocks.select("length", "lane").distinct().groupBy("length").agg(F.collect_list("lane").alias("lanes"))
    all_parts = queries.select("length", "part").distinct().groupBy("length").agg(F.collect_list("part").alias("parts"))
    summaries = blocks.select("length", "lane", "block", "most", "least").join(F.broadcast(all_parts), "length").withColumn("part", F.explode("parts")).drop("parts")
    to_all = queries.join(F.broadcast(all_lanes), "length").withColumn("lane", F.explode("lanes")).drop("lanes")

    def living(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(q):
            return pd.DataFrame({"length": [], "lane": [], "part": [], "block": []}).astype("int64")
        limits = bounds(np.stack(_numbers(q["values"])), np.stack(_numbers(b["most"])), np.stack(_numbers(b["least"])))
        some = (limits >= q["bar"].to_numpy()[:, None]).any(axis=0)
        return b.loc[some, ["length", "lane", "part", "block"]]

    alive = checkpointed(summaries.groupBy("length", "lane", "part").cogroup(to_all.groupBy("length", "lane", "part")).applyInPandas(living, "length int, lane long, part long, block long"))
    sent = alive.join(blocks.select("block", "ids", "rows"), "block")
    met = queries.join(alive.select(*[F.col(c).alias(c) for c in ("length", "lane", "part")]).distinct(), ["length", "part"])

    def cell(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(q):
            return pd.DataFrame({c: [] for c in ("query", "query_id", "vec_id", "score", "scored")}).astype("Int64")
        values = np.stack(_numbers(q["values"]))
        b = b.sort_values("block")
        parts = [(int(n), i, r) for n, i, r in zip(b["block"], _numbers(b["ids"]), _numbers(b["rows"], (-1, values.shape[1])), strict=True)]
        own = q["query"].to_numpy()
        found, scored = search(values, own, q["bar"].to_numpy(), parts, k)
        n = [len(s) for s, _ in found]
        column = lambda *x: pd.array(np.concatenate(x).astype(np.int64), dtype="Int64")
        out = pd.DataFrame({"query": column(np.repeat(own, n)), "query_id": column(np.repeat(q["query_id"].to_numpy(), n)), "vec_id": column(*(x for _, x in found)), "score": column(*(s for s, _ in found))})
        return pd.concat([out, pd.DataFrame({"scored": pd.array([scored], dtype="Int64")})], ignore_index=True)[["query", "query_id", "vec_id", "score", "scored"]]

    cells = sent.groupBy("length", "lane", "part").cogroup(met.groupBy("length", "lane", "part")).applyInPandas(cell, "query long, query_id long, vec_id long, score long, scored long")
    return cells, asked * blocks.count()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, **columns) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its ``k`` best other rows by inner product.

    ``is_query`` is a condition on vec_id.  Values are those of ``integers``; scores are exact,
    and a score that itself exceeds 63 bits is an error.  Only vectors of one length have a product.  Ties go to
    the smaller vec_id; a query with fewer than k other rows has them all.  A row that repeats
    an id is a candidate and, if asked for, a query of its own.  Without rows or queries the
    result is empty.
    """
    cells, _ = _searched(vectors, is_query, k, **columns)
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return cells.where("query is not null").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pruning(vectors: DataFrame, is_query: Column, k: int = 5, **columns) -> tuple[int, int]:
    """How many (query, block) pairs are scored, and how many there are."""
    cells, pairs = _searched(vectors, is_query, k, **columns)
    return cells.agg(F.coalesce(F.sum("scored"), F.lit(0))).first()[0], pairs
