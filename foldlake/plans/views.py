"""Tables by name, and views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Binary places of the part of a step that is summed without rounding.
GRID_BITS = 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(embeddings: DataFrame, step: float = 3.8) -> DataFrame:
    """(label, i, x, y, z): each label's vectors, three components at a time, as steps of one length.

    Steps are summed in two parts: multiples of 2**-GRID_BITS, whose sums are exact up to 2**(53 - GRID_BITS), and the
    small rest.  So the sums of a long chain keep their digits, and round as those of SQL do.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(20)))
    part = embeddings.select("label", "vec_id", k.alias("k"), "embedding")
    part = part.select("label", "vec_id", "k", *[F.get("embedding", 3 * F.col("k") + j).cast("double").alias(c) for j, c in enumerate("xyz")])
    part = part.withColumn("m", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
    w = Window.partitionBy("label").orderBy("vec_id", "k")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = part.select("label", "vec_id", "k", *[(F.col(c) / F.col("m") * step).alias(c) for c in "xyz"])
    coarse = lambda c: F.rint(F.col(c) * float(1 << GRID_BITS)) / float(1 << GRID_BITS)
    return steps.select("label", (F.row_number().over(w) - 1).alias("i"), *[(F.sum(coarse(c)).over(run) + F.sum(F.col(c) - coarse(c)).over(run)).alias(c) for c in "xyz"])


TRACE_SQL = """
_steps AS (
  SELECT label, vec_id, k, CAST(embedding[3 * k + 1] AS DOUBLE) AS x, CAST(embedding[3 * k + 2] AS DOUBLE) AS y, CAST(embedding[3 * k + 3] AS DOUBLE) AS z
  FROM embeddings, range(0, 21) AS t(k)
),
trace AS (
  SELECT label, CAST(row_number() OVER w - 1 AS INTEGER) AS i,
         sum(x / sqrt(x * x + y * y + z * z) * 3.8) OVER w AS x, sum(y / sqrt(x * x + y * y + z * z) * 3.8) OVER w AS y, sum(z / sqrt(x * x + y * y + z * z) * 3.8) OVER w AS z
  FROM _steps WINDOW w AS (PARTITION BY label ORDER BY vec_id, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def event_segments(events: DataFrame) -> DataFrame:
    """(user_id, event_type, lo, hi): maximal runs of one type in each user's events, numbered from 0."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.select("user_id", "event_type", (F.row_number().over(w) - 1).alias("i"), F.coalesce(F.lag("event_type").over(w) != F.col("event_type"), F.lit(True)).alias("new"))
    runs = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(Window.partitionBy("user_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run", "event_type").agg(F.min("i").alias("lo"), F.max("i").alias("hi")).drop("run")


SEGMENT_SQL = """
_numbered AS (SELECT user_id, event_type, CAST(row_number() OVER w - 1 AS INTEGER) AS i, coalesce(lag(event_type) OVER w <> event_type, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
_runs AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY i) AS run FROM _numbered),
seg AS (SELECT user_id, event_type, min(i) AS lo, max(i) AS hi FROM _runs GROUP BY user_id, run, event_type)"""
