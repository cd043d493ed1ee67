"""Removal of lines that many sites share, by sketches of the sites of each line.

Each line (trimmed of spaces, tabs and carriage returns) is hashed to 96 bits.  HyperLogLog
registers over its sites merge by aggregation, partly before the shuffle.  Lines whose
estimate is near the threshold get an exact distinct count; the rest are decided by the
estimate.  Near is from a quarter of the threshold to four standard errors above it: so few
sites are counted by the registers that they fill, so an estimate never exceeds the truth
by a site, and ten sites fill two of the 128 registers or fewer with a chance of 7e-15.
A line on ``sites`` or more sites is boilerplate: it stays in the document of the smallest id
that has it and goes from every other one.

Only DataFrame functions are used.  No group of lines is gathered: a hot line costs one
aggregation buffer per task, and its removal goes by a broadcast of the at most 1,024 lines
that hold 1/1,024 of all lines each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, left_join_unique, whole

SITES = 10
ERROR = 0.1


def _lines(text):
    return F.split(text, "\n", -1)


def cleaned(docs: DataFrame, sites: int = SITES, error: float = ERROR) -> DataFrame:
    """(doc, text, n_lines, n_removed): each row as a struct, and what ``line_dedup`` makes of it."""
    rows = docs.select(whole(docs), "doc_id", "text", "source", F.struct(F.xxhash64("doc_id", "text").alias("h"), F.hash("doc_id", "text").alias("g")).alias("_row"))
    line = F.expr("trim(BOTH ' \t\r' FROM _line)")
    lines = rows.select("doc_id", "_row", F.xxhash64(F.coalesce("source", F.lit("\0"))).alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "_line"))
    lines = lines.withColumn("_line", line).where("_line != ''")
    lines = checkpointed(lines.select("doc_id", "_row", "site", "pos", F.struct(F.xxhash64("_line").alias("h"), F.hash("_line").alias("g")).alias("line")))
    total = lines.count()
    spread = lines.groupBy("line").agg(
        F.approx_count_distinct("site", error).alias("estimate"), F.count("*").alias("n"), F.min("doc_id").alias("first_id")
    )
    spread = checkpointed(spread.where((F.col("estimate") >= sites / 4) & (F.col("n") >= sites)))
    near = spread.where(F.col("estimate") <= sites + max(4 * error * sites, 3))
    exact = (
        left_join_unique(lines.select("line", "site"), near.select("line", "n", F.lit(True).alias("near")), "line", "n", total)
        .where("near")
        .groupBy("line", "site")
        .agg(F.lit(1).alias("one"))
        .groupBy("line")
        .agg(F.count("*").alias("exact"))
    )
    bad = spread.join(exact, "line", "left").where(F.coalesce("exact", "estimate") >= sites).select("line", "n", "first_id", F.lit(True).alias("bad"))
    bad = checkpointed(bad)
    hits = left_join_unique(lines, bad, "line", "n", total).where(F.col("bad") & ~F.col("doc_id").eqNullSafe(F.col("first_id")))
    drops = hits.groupBy("_row").agg(F.collect_set("pos").alias("_drop"))
    out = rows.select("doc", "_row").join(drops, "_row", "left")
    text = F.col("doc").getField("text")
    split = _lines(text)
    keep = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_drop"))
    new = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(F.transform(keep, lambda i: F.get(split, i)), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long")
    n_removed = F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long")
    return out.select("doc", new.alias("text"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def line_dedup(docs: DataFrame, sites: int = SITES, error: float = ERROR) -> DataFrame:
    """``docs`` with its text cleaned, and _n_lines, _n_removed (which replace columns of these names).

    A site is a value of ``source``; null is a site of its own.  Blank lines are never
    removed.  A null text stays null with 0 lines, an empty text is one blank line.  A row
    without an id keeps a boilerplate line only if no row with an id has it.  Equal rows are
    treated alike; a line repeated inside one row counts once for a site.  An empty table
    gives an empty result.
    """
    out = cleaned(docs, sites, error)
    kept = [F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("_n_lines", "_n_removed")]
    return out.select(*kept, F.col("n_lines").alias("_n_lines"), F.col("n_removed").alias("_n_removed"))
