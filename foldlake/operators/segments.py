"""Runs, intervals and votes along a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Maximal runs of one value over consecutive places: (key, value, lo, hi). Null values make none."""
    inside = Window.partitionBy(key, value).orderBy(at)
    marked = rows.where(F.col(value).isNotNull()).withColumn("_island", F.col(at) - F.row_number().over(inside))
    return marked.groupBy(key, value, "_island").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).drop("_island")


def residues(segments: DataFrame, *keys: str, n: Column | None = None) -> DataFrame:
    """The distinct places that inclusive segments cover, clamped to 0..n-1 if n is given."""
    lo, hi = F.least("lo", "hi"), F.greatest("lo", "hi")
    if n is not None:
        lo, hi = F.greatest(F.lit(0), lo), F.least(n - 1, hi)
    places = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    return segments.select(*keys, F.explode(places).alias("i")).distinct()


def merged(segments: DataFrame, key: str) -> DataFrame:
    """Union of inclusive segments; those that touch (lo <= hi + 1) become one."""
    before = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("lo") > F.max("hi").over(before) + 1).cast("int"), F.lit(1))
    upto = Window.partitionBy(key).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    return segments.withColumn("_new", new).withColumn("_run", F.sum("_new").over(upto)).groupBy(key, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")


def largest_gap(segments: DataFrame, lengths: DataFrame, key: str, least: int = 4) -> DataFrame:
    """The first longest stretch of 0..n-1 that no segment covers; 40 % to 60 % of the chain if under ``least``.

    ``lengths`` has (key, n).  Gaps are what lies between merged segments, so no place is listed.
    """
    ends = lengths.select(key, F.lit(-1).alias("lo"), F.lit(-1).alias("hi")).unionByName(lengths.select(key, F.col("n").alias("lo"), F.col("n").alias("hi")))
    solid = merged(segments.select(key, "lo", "hi"), key).unionByName(ends)
    following = Window.partitionBy(key).orderBy("lo", "hi")
    gaps = solid.select(key, (F.col("hi") + 1).alias("lo"), (F.lead("lo").over(following) - 1).alias("hi")).where("hi >= lo")
    best = gaps.groupBy(key).agg(F.max_by(F.struct("lo", "hi"), F.struct((F.col("hi") - F.col("lo")).alias("size"), (-F.col("lo")).alias("first"))).alias("gap"))
    out = lengths.join(best, key, "left")
    wide = F.coalesce(F.col("gap.hi") - F.col("gap.lo") + 1 >= least, F.lit(False))
    return out.select(
        key,
        F.when(wide, F.col("gap.lo")).otherwise(F.floor(F.col("n") * 0.4)).cast("int").alias("lo"),
        F.when(wide, F.col("gap.hi")).otherwise(F.floor(F.col("n") * 0.6)).cast("int").alias("hi"),
    )


def clean(segments: DataFrame, key: str, domain: str, least: int = 4) -> DataFrame:
    """Segments of ``least`` places or more, of domains with ``least`` distinct places or more."""
    kept = segments.where(F.col("hi") - F.col("lo") + 1 >= least)
    big = residues(kept, key, domain).groupBy(key, domain).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return kept.join(big.select(key, domain), [key, domain], "left_semi")


def signature(segments: Column) -> Column:
    """lo-hi of each segment joined by +, of an array of (lo, hi)."""
    return F.array_join(F.transform(segments, lambda s: F.concat_ws("-", s["lo"].cast("string"), s["hi"].cast("string"))), "+")


def modal_count(votes: DataFrame, key: str, count: str) -> DataFrame:
    """The commonest count of each key, ties to the smaller: (key, modal, n_votes, n_runs)."""
    tally = votes.groupBy(key, count).agg(F.count("*").alias("n"))
    return tally.groupBy(key).agg(
        F.max_by(count, F.struct("n", -F.col(count))).alias("modal"), F.max("n").alias("n_votes"), F.sum("n").alias("n_runs")
    )


def of_modal_count(votes: DataFrame, key: str, count: str) -> DataFrame:
    """The votes with the commonest count of their key, ties to the smaller, out of one pass over them."""
    rows = votes.withColumn("_n", F.count("*").over(Window.partitionBy(key, count)))
    rows = rows.withColumn("_modal", F.max(F.struct("_n", (-F.col(count)).alias("low"))).over(Window.partitionBy(key)))
    return rows.where(F.col(count) == -F.col("_modal.low")).drop("_n", "_modal")


def majority_label(labels: DataFrame, key: str, at: str, label: str) -> DataFrame:
    """(key, at, label, stability): the commonest label, ties to the lowest and unassigned last; its share of the runs.

    A null label is unassigned; it can win, and then the label is null.
    """
    tally = labels.groupBy(key, at, label).agg(F.count("*").alias("n"))
    rank = F.struct("n", F.when(F.col(label).isNull(), F.lit(-(2**30))).otherwise(-F.col(label)).alias("low"))
    best = tally.groupBy(key, at).agg(F.max(F.struct(rank.alias("rank"), F.col(label).alias("label"))).alias("best"), F.sum("n").alias("runs"))
    return best.select(key, at, F.col("best.label").alias(label), (F.col("best.rank.n") / F.col("runs")).alias("stability"))


def trim_unstable(votes: DataFrame, key: str, at: str, label: str, stability: str, stable: float = 0.999, least: int = 40, keep: float = 0.45) -> DataFrame:
    """``votes`` whose ends of each domain are unassigned (null) up to the first place of ``stable`` votes.

    A domain of under ``least`` places stays, and none shrinks below ``least`` or the share
    ``keep`` of its places.  The front is trimmed first.  Inner places stay whatever their votes.
    """
    w = Window.partitionBy(key, label).orderBy(at)
    whole = Window.partitionBy(key, label)
    sure = F.when(F.col(stability) >= stable, F.col("_k"))
    rows = votes.withColumn("_k", F.row_number().over(w)).withColumn("_n", F.count("*").over(whole))
    rows = rows.withColumn("_first", F.min(sure).over(whole)).withColumn("_last", F.max(sure).over(whole))
    spare = F.greatest(F.lit(0), F.col("_n") - F.greatest(F.lit(least), F.ceil(F.col("_n") * keep)))
    spare = F.when(F.col("_n") >= least, spare).otherwise(0)
    front = F.least(F.coalesce(F.col("_first") - 1, F.col("_n")), spare)
    back = F.least(F.coalesce(F.col("_n") - F.col("_last"), F.col("_n")), spare - front)
    kept = (F.col("_k") > front) & (F.col("_k") <= F.col("_n") - back)
    return rows.withColumn(label, F.when(kept, F.col(label))).drop("_k", "_n", "_first", "_last")


def coassociation(labels: DataFrame, key: str, run: str, at: str, label: str, bins: int, n: Column) -> DataFrame:
    """(key, a, b, votes): of all runs, how many give the middles of bins a and b one label.

    At most ``bins`` middles a key are read, so the pairs of a label are bounded by bins squared.
    Rows that lie by their key are not shuffled.
    """
    size = F.least(F.lit(bins), F.col("_n"))
    # a place is the middle of the bins about its share of the bins, if of any; null places and sizes are of none
    about = F.floor(F.col(at) * size / F.col("_n")).cast("int")
    middle = F.filter(F.sequence(about - 1, about + 1), lambda k: (k >= 0) & (k < size) & (F.floor((k + 0.5) * F.col("_n") / size) == F.col(at)))
    rows = labels.select(key, run, at, label, n.alias("_n")).where(F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(run).isNotNull() & (F.col("_n") > 0))
    seen = rows.select(key, run, label, F.explode(middle).alias("a"))
    # the bins of a label meet in one row, so nothing is dealt again that lies by its key
    met = seen.groupBy(key, run, label).agg(F.collect_list("a").alias("_bins"))
    return met.select(key, F.explode("_bins").alias("a"), "_bins").select(key, "a", F.explode("_bins").alias("b")).groupBy(key, "a", "b").agg(F.count("*").alias("votes"))


def window_densest(values: DataFrame, key: str, at: str, flag: str) -> DataFrame:
    """Of a row of n flags repeated once, the start of the fullest window of n: (key, cut, n_in).

    Starts are 0 to n - 2; the first of equals stays.
    """
    sized = values.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    twice = sized.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1))))
    twice = twice.withColumn("_at", F.col(at) + F.col("_copy") * F.col("_n")).withColumn("_f", F.col(flag).cast("int"))
    upto = Window.partitionBy(key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sums = twice.withColumn("_sum", F.sum("_f").over(upto))
    # the window from r holds the sum up to r + n - 1 less the sum up to r - 1
    end = sums.select(key, (F.col("_at") - F.col("_n") + 1).alias("cut"), "_n", F.col("_sum").alias("_hi")).where("cut between 0 and _n - 2")
    start = sums.select(key, (F.col("_at") + 1).alias("cut"), F.col("_sum").alias("_lo"))
    held = end.join(start, [key, "cut"], "left").withColumn("n_in", F.col("_hi") - F.coalesce("_lo", F.lit(0)))
    return held.groupBy(key).agg(F.max_by(F.struct("cut", "n_in"), F.struct("n_in", -F.col("cut"))).alias("best")).select(key, "best.cut", "best.n_in")
