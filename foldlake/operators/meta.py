"""Row metadata: offsets, blocks, shards, as-of lookups and class dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def prefix_offsets(rows: DataFrame, at: str, size: str, block: int = 4096) -> DataFrame:
    """``rows`` with offset: the sum of ``size`` over all rows before.

    Sums run inside blocks of ``block`` rows in parallel, then over the totals of as many blocks at
    a time; one number for each ``block`` times ``block`` rows is summed in one place.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(at) / block)).withColumn("_group", F.floor(F.col("_block") / block))
    before = lambda *by, place: Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda what, w: F.coalesce(F.sum(what).over(w), F.lit(0))
    totals = blocked.groupBy("_group", "_block").agg(F.sum(size).alias("_t"))
    groups = totals.groupBy("_group").agg(F.sum("_t").alias("_g"))
    groups = groups.select("_group", running("_g", before(place="_group")).alias("_far"))
    base = totals.withColumn("_near", running("_t", before("_group", place="_block"))).join(groups, "_group").select("_block", (F.col("_far") + F.col("_near")).alias("_base"))
    out = blocked.withColumn("_in", running(size, before("_block", place=at))).join(base, "_block")
    return out.withColumn("offset", F.col("_base") + F.col("_in")).drop("_group", "_block", "_base", "_in")


def locate(rows: DataFrame, shards: DataFrame, at: str = "row", first: str = "row0") -> DataFrame:
    """As-of lookup: the last shard that begins at or before each row, null before the first.

    Shards and rows are merged in one ordered pass of each range of rows; the shard that is
    open when a range begins comes from the few last shards of the ranges before.
    """
    span = 65536
    both = rows.select(F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(shards.schema.simpleString()).alias("_shard")).unionByName(
        shards.select(F.col(first).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema.simpleString()).alias("_row"), F.struct(*shards.columns).alias("_shard"))
    )
    both = both.withColumn("_range", F.floor(F.col("_at") / span))
    ordered = Window.partitionBy("_range").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_here", F.last("_shard", ignorenulls=True).over(ordered))
    last = both.groupBy("_range").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_shard"))).alias("_l"))
    carried = last.withColumn("_open", F.last("_l", ignorenulls=True).over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    out = both.where("_side = 1").join(carried.select("_range", "_open"), "_range")
    return out.select("_row.*", F.coalesce("_here", "_open._shard").alias("shard"))


def greedy_shards(rows: DataFrame, at: str, size: str, capacity: int) -> DataFrame:
    """``rows`` with shard: a new one begins where the next record would not fit; no record straddles two.

    What comes first in a shard that is still empty always fits, however large.

    Every row has a pointer to the row at which a shard that began with it would end, found
    among the prefix sums.  The rows that do begin a shard are those that pointers lead to from
    the first; each turn doubles the length of the pointers and the part of the way that is
    known, so a million shards take twenty joins of two numbers a row.
    """
    own = rows.select(F.col(at).cast("long").alias("_at"), F.col(size).cast("long").alias("_size"), F.lit(1).cast("long").alias("_one"))
    own = prefix_offsets(prefix_offsets(own, "_at", "_one").withColumnRenamed("offset", "place"), "_at", "_size")
    own = cut(own.select("_at", "place", F.col("offset").alias("low"), (F.col("offset") + F.col("_size")).alias("high")))
    ends = own.groupBy("high").agg(F.max("place").alias("last"))
    ends = cut(ends.select(F.col("high").alias("row0"), "last"))
    upto = lambda rows: F.coalesce(F.col("shard.last"), F.lit(-1)).alias(rows)
    fits = locate(own.select("place", "low", (F.col("low") + capacity).alias("row")), ends).select("place", F.col("low").alias("row"), upto("fits"))
    nothing = locate(fits, ends).select("place", "fits", upto("nothing"))
    jump = cut(nothing.select("place", (F.greatest(F.col("fits"), F.col("nothing") + 1) + 1).cast("long").alias("next")))
    total = own.count()
    begun = own.where("place = 0").select("place")
    reached = 1 if total else 0
    while True:
        begun = cut(begun.union(begun.join(jump, "place").where(F.col("next") < total).select(F.col("next").alias("place"))).distinct())
        n = begun.count()
        if n == reached:
            break
        reached = n
        to = jump.select(F.col("place").alias("next"), F.col("next").alias("far"))
        jump = cut(jump.join(to, "next", "left").select("place", F.coalesce("far", F.lit(total)).alias("next")))
    first = own.join(begun.withColumn("_new", F.lit(1).cast("long")), "place", "left").select("_at", F.coalesce("_new", F.lit(0).cast("long")).alias("_new"))
    numbered = prefix_offsets(first, "_at", "_new").select(F.col("_at").alias(at), (F.col("offset") + F.col("_new") - 1).alias("shard"))
    return rows.join(numbered, at)


def classify(rows: DataFrame, paths: DataFrame, names: DataFrame) -> DataFrame:
    """Dictionary lookups of a hierarchy: rows (.., path) to the code of the path and the name of its group."""
    return rows.join(paths, "path", "left").join(names, "name_id", "left")
