"""Streams: hits judged as they arrive, superseded requests dropped, and events by window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import LongType, StringType, StructField, StructType


def latest_generation(hits: DataFrame, request: str = "request", generation: str = "generation") -> DataFrame:
    """Only the rows of the newest generation of each request; those of a request without any stay."""
    newest = hits.groupBy(F.col(request).alias("_request")).agg(F.max(generation).alias("_newest"))
    rows = hits.join(newest, F.col(request).eqNullSafe(F.col("_request")))
    return rows.where(F.col(generation).eqNullSafe(F.col("_newest"))).select(*hits.columns)


def _numbers(column: pd.Series) -> np.ndarray:
    """Generations as integers; null is older than any."""
    return pd.to_numeric(column).fillna(-1).to_numpy(dtype=np.int64)


def newest_only(hits: DataFrame, request: str = "request", generation: str = "generation") -> DataFrame:
    """A stream of hits without those of a superseded generation, also of one superseded in an earlier micro-batch.

    The state of a request is one number, the newest generation seen; hits of one request in
    one micro-batch are judged by the newest of both.  A null generation is older than any.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, frames = _newest(batches, generation, state.get[0] if state.exists else -1)
        state.update((newest,))
        yield from frames

    return hits.groupBy(request).applyInPandasWithState(keep, hits.schema, "newest long", "append", "NoTimeout")


def _newest(batches: Iterator[pd.DataFrame], generation: str, newest: int) -> tuple[int, list[pd.DataFrame]]:
    """The newest generation, and the rows of it; older rows are dropped as they are read."""
    frames: list[pd.DataFrame] = []
    for f in batches:
        own = _numbers(f[generation])
        top = int(own.max(initial=newest))
        if top > newest:
            newest, frames = top, []
        if (own == newest).any():
            frames.append(f[own == newest])
    return newest, frames


def verdict_stream(hits: DataFrame, hit: str = "hit", total: str = "total", request: str = "request", generation: str = "generation") -> DataFrame:
    """A stream of (.., kind, done): each hit of the newest generation once, as kind "hit", and one row of kind "end" when all are there.

    ``total`` says how many different hits a generation has; done counts those seen so far.  A
    superseded generation gives nothing more, and no end if it was not complete.  Hits that come
    again are passed over, as is what comes after the end.  The state of a request is its newest
    generation and the hashes of its hits; an end row has a null hit and the columns of the last.
    """
    schema = StructType([*hits.schema.fields, StructField("kind", StringType()), StructField("done", LongType())])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, seen = (state.get[0], list(state.get[1])) if state.exists else (-1, [])
        newest, frames = _newest(batches, generation, before)
        known = set(seen) if newest == before else set()
        seen = seen if newest == before else []
        out = []
        for f in frames:
            names = pd.util.hash_array(f[hit].astype(str).to_numpy(dtype=object)).astype(np.int64)
            for k, name in enumerate(names.tolist()):
                if name in known:
                    continue
                known.add(name)
                seen.append(name)
                row = f.iloc[[k]].assign(kind="hit", done=len(seen))
                out.append(row)
                if len(seen) == int(f[total].iloc[k]):
                    out.append(row.assign(**{hit: None}, kind="end"))
        state.update((newest, seen))
        if out:
            yield pd.concat(out, ignore_index=True)[schema.names]

    return hits.groupBy(request).applyInPandasWithState(run, schema, "newest long, seen array<long>", "append", "NoTimeout")


def judge(hits: DataFrame, score: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Writes the verdicts of each micro-batch of hits to a Parquet folder, a batch number with each row.

    A hit of a generation that any earlier batch has superseded is not judged.  A batch that is
    run again overwrites its own folder, so each hit is judged once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        score(rows).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return newest_only(hits).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total): events by time window; with ``late`` a stream forgets older windows."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.unix_timestamp("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n): events of a user that are less than ``gap`` apart."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("end"), "n")
