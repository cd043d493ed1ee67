"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Rows of a source are dealt by a hash of the whole row into permuted blocks, so a block is a
   random subset of its source; a source that holds a third of all rows has many blocks.
2. Targets: each source gets its weight's share of ``factor`` times all words, but at most
   ``most`` times its own words; what is cut off is shared again by weight (water filling,
   solved on the sorted ratios of cap to weight, one row for each source).
3. The target becomes an exact quota of blocks: whole passes over the source, then whole
   blocks in permuted order up to a last one that is cut.  A cut block that is larger than
   ``BLOCK_WORDS`` is dealt into blocks again, so the search narrows by a factor of ``BLOCKS``
   a level.  Only the last of them is looked at row by row: rows that fit, in permuted order,
   then the one that best fills what is left.
4. The quotas are split from the root of a binary tree down to the output shards: each node
   sends half of its draws to either child, by a multivariate hypergeometric draw, so every
   shard is an exact random share of the mix.  The upper half of the tree is one task over a
   row for each source; each subtree below is a task of its own.  A leaf takes the next
   blocks of each source.
5. Rows go to their shard and are ordered there by a hash: the local shuffle.

All planning is on rows of a few numbers; blocks number at most ``BLOCKS`` and one for each
source.  Tables of sources and of blocks are broadcast where they are counted to have at
most ``SMALL`` rows and join by ``left_join_unique`` beyond.  Texts move once, to their shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, fields, left_join_unique, narrowed, whole

WEIGHTS = (3, 1, 2)
FACTOR, MOST = 1.5, 2.0
BLOCK_WORDS = 200_000
BLOCKS = 4096
SMALL = 65_536
#: Output shards hold about SHARD_WORDS words each, between FEWEST and SHARDS of them; larger
#: ones are shuffled in slots of that size, one task each.
SHARD_WORDS, FEWEST, SHARDS = 10_000_000, 16, 65_536
SEED = 20240607


def words(text: Column) -> Column:
    """The words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: float = MOST) -> DataFrame:
    """(source, source_size) with target: ``weights`` repeat over the sources by code point, null last."""
    everywhere = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size"))
    before = everywhere.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_goal", factor * F.sum("source_size").over(everywhere))
    # the level if only the sources before this one were cut off
    cut, light = F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    t = t.withColumn("_level", (F.col("_goal") - cut) / (F.sum("_w").over(everywhere) - light))
    t = t.withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_cap"))
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everywhere)
    return t.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(level * F.col("_w")).alias("target"))


def _grown(stop: int, seed: int):
    """Nodes (first, n) of the tree, a row for each source with draws there, to their offspring of at most ``stop`` shards.

    A row has the node's quota of the source and lo, the draws of the source in the shards before.
    """
    names = ["first", "n", "source_key", "quota", "lo"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_key", ignore_index=True)
        key, out = rows["source_key"].to_numpy(), []
        at = np.arange(len(rows))
        nodes = [(int(rows["first"].iloc[0]), int(rows["n"].iloc[0]), at, rows["quota"].to_numpy(np.int64), rows["lo"].to_numpy(np.int64))]
        while nodes:
            first, n, at, quota, lo = nodes.pop()
            if n <= stop:
                out.append(pd.DataFrame({"first": first, "n": n, "source_key": key[at], "quota": quota, "lo": lo}))
                continue
            total, half = int(quota.sum()), n // 2
            left = np.random.default_rng([seed, first, n]).multivariate_hypergeometric(quota, total * half // n, method="marginals")
            for start, size, own, begin in ((first, half, left, lo), (first + half, n - half, quota - left, lo + left)):
                some = own > 0
                if some.any():
                    nodes.append((start, size, at[some], own[some], begin[some]))
        return pd.concat(out, ignore_index=True)[names] if out else pd.DataFrame({c: [] for c in names})

    return run


def tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_key, quota) to (source_key, shard, lo, hi): positions lo..hi of the source's draws; empty shares are left out."""
    schema = "first int, n int, source_key string, quota long, lo long"
    root = quotas.where("quota > 0").select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "source_key", "quota", F.lit(0).cast("long").alias("lo"))
    upper = root.groupBy("first", "n").applyInPandas(_grown(math.isqrt(shards), seed), schema)
    leaves = upper.groupBy("first", "n").applyInPandas(_grown(1, seed), schema)
    return leaves.select("source_key", F.col("first").alias("shard"), "lo", (F.col("lo") + F.col("quota")).alias("hi"))


def _filled(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of a source's last block: how many of each kind are taken (c) to come nearest to ``left`` words."""
    rows = rows.sort_values(["_order", "doc_id", "_size"], ignore_index=True)
    size, n = rows["_size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    left, c = float(rows["left"].iloc[0]), np.zeros(len(rows), dtype=np.int64)
    for k in range(len(rows)):
        c[k] = min(n[k], int(left // size[k]))
        left -= float(c[k] * size[k])
    more = np.flatnonzero((c < n) & (np.abs(size - left) < left))
    if len(more):
        c[more[np.argmin(np.abs(size[more] - left))]] += 1
    return rows.assign(c=c)[["source_key", "_order", "_id", "_size", "c"]]


def _joined(rows: DataFrame, few: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Left join with a table that has one row for each ``key``, ``n`` being the key's rows."""
    if few.count() <= SMALL:
        return rows.join(F.broadcast(few.withColumnRenamed(key, "_few").drop(n)), F.col(key) == F.col("_few"), "left").drop("_few")
    return left_join_unique(rows, few, key, n, total).drop(n)


def plan(
    docs: DataFrame, size: Column | None = None, mark: Column | None = None, weights: tuple[int, ...] = WEIGHTS, factor: float = FACTOR, most: float = MOST, shards: int | None = None, seed: int = SEED
) -> DataFrame:
    """(doc, size, source_size, target, shards, slots, place): doc is the row as a struct, shards the output shard of each of its copies.

    slots is one number for all rows, the tasks that a shard is worth; place is the row's hash.
    ``size`` defaults to the words of text, ``mark`` (what tells apart rows of one id) to a
    hash of text.  Every row of the input is in the result; a row that the mix leaves out has
    no shard.  A null source is a source of its own, the last in the order of weights; rows
    without words have size 0 and may be drawn at no cost.  Rows are units of their own even
    if they repeat an id; rows that agree in id, source and text are in one block, may be
    drawn differently in the last one, and reruns on one table agree in how many are.  An
    empty table gives an empty result.
    """
    size = (words(F.col("text")) if size is None else size).cast("long")
    mark = F.xxhash64("text") if mark is None else mark
    # the source's name itself as a key that is never null
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    keyed = docs.select(whole(docs), key.alias("source_key"), F.xxhash64("doc_id", "source", mark, F.lit(seed)).alias("_order"), F.col("doc_id").alias("_id"), size.alias("_size"))
    narrow = checkpointed(keyed.select("source_key", F.col("doc.source").alias("source"), "_order", "_id", "_size"))
    sizes = narrow.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("rows"))
    total, rows, sources = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0)), F.count("*")).first()
    few = lambda table: checkpointed(narrowed(table, sources + 2 * BLOCKS))  # noqa: E731  a row for each source or block
    if shards is None:
        shards = int(min(SHARDS, max(FEWEST, -(-factor * total // SHARD_WORDS))))
    slots = int(max(1, -(-factor * total // (shards * SHARD_WORDS))))
    load = max(BLOCK_WORDS, -(-(total + rows) // BLOCKS))  # a row weighs one word more than it has
    goals = targets(sizes.select("source", "source_size"), weights, factor, most).withColumn("source_key", key)
    goals = goals.join(sizes.select(key.alias("source_key"), "rows"), "source_key")
    goals = goals.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("left", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("n0", F.ceil((F.col("source_size") + F.col("rows")) / load))
    goals = few(goals.drop("source"))
    narrow = narrow.drop("source")
    # the cut of each source: its block in each level, and what it may still take there
    levels = 1 + (math.ceil(math.log(load / BLOCK_WORDS, BLOCKS) - 1e-9) if load > BLOCK_WORDS else 0)
    digit = lambda k: F.pmod(F.xxhash64("_order", F.lit(k)), F.col(f"n{k}"))
    inside, blocks = narrow, None
    for k in range(levels):
        in_source = Window.partitionBy("source_key").orderBy("block")
        here = _joined(inside, goals.select("source_key", "rows", f"n{k}"), "source_key", "rows", rows).withColumn("block", digit(k))
        here = here if k == 0 else checkpointed(here)
        summed = here.groupBy("source_key", "block").agg(F.sum("_size").alias("words"), F.count("*").alias("n")).join(goals.select("source_key", "left", "passes"), "source_key")
        summed = few(summed.withColumn("end", F.sum("words").over(in_source)))
        over = summed.where(F.col("end") > F.col("left")).groupBy("source_key").agg(F.min_by(F.struct("block", "n", "words", (F.col("left") - F.col("end") + F.col("words")).alias("left")), "block").alias("cut"))
        blocks = summed if k == 0 else blocks
        goals = goals.withColumnRenamed("left", f"left{k}").join(over, "source_key", "left")
        goals = goals.withColumn(f"cut{k}", F.coalesce("cut.block", F.col(f"n{k}"))).withColumn("left", F.coalesce("cut.left", F.lit(0.0)))
        goals = few(goals.withColumn(f"n{k + 1}", F.least(F.lit(BLOCKS), F.ceil((F.coalesce("cut.words", F.lit(0)) + F.coalesce("cut.n", F.lit(0))) / BLOCK_WORDS))).withColumn(f"n{k + 1}", F.greatest(F.lit(1), f"n{k + 1}")).drop("cut"))
        here = _joined(here, goals.select("source_key", "rows", f"cut{k}", "left"), "source_key", "rows", rows)
        inside = here.where((F.col("block") == F.col(f"cut{k}")) & (F.col("left") > 0)).select("source_key", "_order", "_id", "_size")
    kinds = inside.where("_size > 0").groupBy("source_key", "_order", "_id", "_size").agg(F.count("*").alias("n")).join(goals.select("source_key", "left"), "source_key")
    chosen = kinds.withColumn("doc_id", F.coalesce("_id", F.lit(0))).groupBy("source_key").applyInPandas(_filled, "source_key string, _order long, _id long, _size long, c long")
    chosen = checkpointed(narrowed(chosen.where("c > 0"), sources * (BLOCK_WORDS // 100)))
    # the draws of a source in order: all blocks of the first pass, permuted, then those of the next
    first = goals.select("source_key", "cut0", F.col("left" if levels == 1 else "left1").alias("rest"))
    drawn = F.col("passes") + ((F.col("block") < F.col("cut0")) | ((F.col("block") == F.col("cut0")) & (F.col("rest") > 0))).cast("long")
    blocks = few(blocks.join(first, "source_key").select("source_key", "block", "n", drawn.alias("drawn")))
    quotas = blocks.groupBy("source_key").agg(F.sum("drawn").alias("quota"))
    shares = tree(quotas, shards, seed).select("source_key", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("draw"))
    draws = blocks.where("drawn > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1)))
    in_pass = Window.partitionBy("source_key").orderBy("copy", F.xxhash64("block", "copy", F.lit(seed)), "block")
    draws = draws.select("source_key", "block", "n", "copy", (F.row_number().over(in_pass) - 1).cast("long").alias("draw"))
    where = F.struct("source_key", "block").alias("_home")
    homes = draws.join(shares, ["source_key", "draw"]).groupBy("source_key", "block").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("homes"))
    homes = few(homes.select(where, "n", "homes"))
    # every row by the digits of its block, against the cut of its source
    per_source = goals.select("source_key", "rows", "source_size", "target", "passes", "left", *[f"{c}{k}" for k in range(levels) for c in ("n", "cut")])
    out = _joined(keyed, per_source, "source_key", "rows", rows)
    same, below = F.lit(True), F.lit(False)
    for k in range(levels):
        below = below | (same & (digit(k) < F.col(f"cut{k}")))
        same = same & (digit(k) == F.col(f"cut{k}"))
    out = out.withColumn("block", digit(0)).withColumn("_last", same & (F.col("left") > 0))
    out = _joined(out.withColumn("_home", F.struct("source_key", "block")), homes, "_home", "n", rows)
    names = ["doc", "source_key", "_order", "_id", "_size", "source_size", "target", "passes", "homes"]
    plain = out.where(~F.col("_last")).select(*names, below.cast("long").alias("_extra"))
    # rows of the last block: as many of each kind as are chosen
    kind = F.struct("source_key", "_order", F.col("_id").isNull().alias("none"), F.coalesce("_id", F.lit(0)).alias("id"), "_size").alias("_kind")
    turn = F.row_number().over(Window.partitionBy("_kind").orderBy(F.lit(0)))
    last = out.where("_last").select(*names, kind).withColumn("_turn", turn).join(chosen.select(kind, "c"), "_kind", "left")
    last = last.select(*names, F.coalesce((F.col("_turn") <= F.col("c")).cast("long"), F.lit(0).cast("long")).alias("_extra"))
    out = plain.union(last).withColumn("_copies", (F.col("passes") + F.col("_extra")).cast("int"))
    homes = F.when(F.col("_copies") > 0, F.slice("homes", F.lit(1), F.col("_copies"))).otherwise(F.array().cast("array<int>"))
    return out.select("doc", F.col("_size").alias("size"), "source_size", "target", homes.alias("shards"), F.lit(slots).alias("slots"), F.col("_order").alias("place"))


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED, **how) -> DataFrame:
    """The mixed rows: the columns of ``docs``, shard, copy (from 0), in shuffled order inside each shard's slots.

    Columns of these two names are replaced; all others keep their names and values.
    """
    rows = plan(docs, shards=shards, seed=seed, **how).select("doc", "slots", "place", F.posexplode("shards").alias("copy", "shard"))
    place = F.xxhash64("place", "copy", F.lit(seed + 1))
    rows = rows.withColumn("_slot", F.pmod(place, "slots")).withColumn("_place", place).repartition("shard", "_slot")
    return rows.sortWithinPartitions("shard", "_slot", "_place", F.col("doc").getField("doc_id"), "copy").select(*fields(docs, without=("shard", "copy")), "shard", "copy")
