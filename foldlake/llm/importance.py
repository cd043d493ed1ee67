"""Importance resampling towards a target distribution, by hashed n-grams.

1. In each partition DuckDB unnests the words of a slice of texts, forms n-grams by window
   functions, hashes each different n-gram once by a registered zlib crc32, and counts buckets
   for each row.
2. The counts are written as Parquet in the folder that the cluster shares, so texts are read
   once.  Spark merges them into one count for each bucket: at most ``BUCKETS`` rows.
3. A bucket's gain is the log-ratio of its smoothed shares in the target and in the corpus; a
   document's weight is the mean gain of its n-grams.  Gumbel noise from a hash of the id turns
   the highest scores into a draw without replacement, the same on every run.
4. Rows are sorted by range; a rank is the place in a range and the sizes of the ranges before.

A long text goes to DuckDB in pieces of about ``SLICE`` bytes that carry the words before them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import words as W
from .shared import checkpointed, fields, partitions, spilled

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
SLICE = 4 << 20

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = np.zeros(256, dtype=bool)
_GAPS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def _crc32(grams: pa.Array) -> pa.Array:
    return pa.array([zlib.crc32(g.encode()) for g in grams.to_pylist()], pa.int64())


def _counting_sql(most: int, buckets: int) -> str:
    """(r, words, features, bucket, n) of the texts (r, skip, text); n-grams that end in the first ``skip`` words only carry on."""
    ended = [" || ' ' || ".join([*(f"lag(w, {k}) OVER o" for k in range(size - 1, 0, -1)), "w"]) for size in range(1, most + 1)]
    grams = " UNION ALL ".join(f"SELECT r, g{size} AS g FROM placed WHERE i > skip AND g{size} IS NOT NULL" for size in range(1, most + 1))
    columns = ", ".join(f"{e} AS g{size}" for size, e in enumerate(ended, 1))
    return rf"""
WITH texted AS (SELECT r, skip, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{WORD}') AS ws FROM texts),
worded AS (SELECT r, skip, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM texted),
placed AS (SELECT r, skip, i, {columns} FROM worded WINDOW o AS (PARTITION BY r ORDER BY i)),
counted AS (SELECT r, g, count(*) AS n FROM ({grams}) GROUP BY r, g),
hashed AS (SELECT g, crc32(g) % {buckets} AS bucket FROM (SELECT DISTINCT g FROM counted)),
summed AS (SELECT r, bucket, CAST(sum(n) AS BIGINT) AS n FROM counted JOIN hashed USING (g) GROUP BY r, bucket),
listed AS (SELECT r, list(bucket ORDER BY bucket) AS bucket, list(n ORDER BY bucket) AS n FROM summed GROUP BY r)
SELECT r, len(ws) - skip AS words, bucket, n FROM texted LEFT JOIN listed USING (r) ORDER BY r
"""


def _pieces(column: pa.Array, most: int, size: int) -> Iterator[tuple[int, int, bool, pa.Table]]:
    """Rows lo..hi, whole or not, as tables (r, skip, text) of about ``size`` bytes; a longer row comes in several that begin with the words before them."""
    data, offsets = W.buffers(column)
    for lo, hi in W.slices(offsets, size):
        if offsets[hi] - offsets[lo] <= size:
            rows = column.slice(lo, hi - lo).fill_null("")
            yield lo, hi, True, pa.table({"r": pa.array(range(hi - lo), pa.int64()), "skip": pa.array([0] * (hi - lo), pa.int64()), "text": rows})
            continue
        before: list[str] = []
        for piece in W.chunks(data[offsets[lo] : offsets[hi]], size, _GAPS):
            text = piece.tobytes().decode(errors="replace")
            yield lo, hi, False, pa.table({"r": pa.array([0], pa.int64()), "skip": pa.array([len(before)], pa.int64()), "text": [" ".join([*before, text])]})
            if most > 1:
                before = [*before, *(w.translate(str.maketrans(_UPPER, _LOWER)) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text))][1 - most :]


def _counted(most: int, buckets: int, size: int):
    """(doc, mark, text) to (doc, mark, words, bucket, n): each row's words, and its n-grams by bucket, counted in DuckDB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "1GB"})
        con.create_function("crc32", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
        query = _counting_sql(most, buckets)
        kind = pa.list_(pa.int64())
        for batch in batches:
            words = np.zeros(batch.num_rows, dtype=np.int64)
            held: list[list[np.ndarray] | None] = [None] * batch.num_rows
            found: list[pa.Table | int] = []
            for lo, hi, complete, texts in _pieces(batch.column(2), most, size):
                con.register("texts", texts)
                part = con.sql(query).to_arrow_table()
                con.unregister("texts")
                words[lo:hi] += part.column("words").to_numpy()
                if complete:
                    found.append(part.select(["bucket", "n"]).cast(pa.schema([("bucket", kind), ("n", kind)])))
                    continue
                if held[lo] is None:
                    held[lo] = [np.zeros(buckets, dtype=np.int64)]
                    found.append(lo)
                if part.column("bucket").null_count == 0:
                    held[lo][0][part.column("bucket").combine_chunks().flatten().to_numpy()] += part.column("n").combine_chunks().flatten().to_numpy()
            tables = []
            for part in found:
                if isinstance(part, int):
                    seen = np.flatnonzero(held[part][0])
                    part = pa.table({"bucket": pa.array([seen.tolist()], kind), "n": pa.array([held[part][0][seen].tolist()], kind)})
                tables.append(part)
            if tables:
                both = pa.concat_tables(tables)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words), both.column("bucket").combine_chunks(), both.column("n").combine_chunks()], ["doc", "mark", "words", "bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, most: int = 1, buckets: int = BUCKETS, text: str = "text", carried: tuple[str, ...] | None = None) -> DataFrame:
    """(doc, mark, words, bucket, n) of each row: its columns, a hash of its text, its words, and the counts of its n-grams of 1 to ``most`` words.

    ``carried`` names the columns that doc keeps (all, if None).  Null texts have no words.  The
    result is a table of Parquet in the folder of ``spark.checkpoint.dir``.
    """
    names = docs.columns if carried is None else list(carried)
    doc = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(0)
    rows = docs.select(doc.alias("doc"), F.xxhash64(text).alias("mark"), F.col(f"`{text}`").alias("text"))
    schema = StructType([rows.schema["doc"], StructField("mark", LongType()), StructField("words", LongType()), StructField("bucket", ArrayType(LongType())), StructField("n", ArrayType(LongType()))])
    return spilled(rows.mapInArrow(_counted(most, buckets, SLICE), schema))


def merged(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The n-grams of each bucket over all rows: ``buckets`` numbers, whatever the corpus."""
    pairs = counts.where("bucket is not null").select(F.inline(F.arrays_zip("bucket", "n")))
    out = np.zeros(buckets, dtype=np.int64)
    for row in pairs.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> list[int]:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of each of B buckets, in doubles."""
    b, t_all, s_all = len(corpus), float(target.sum()), float(corpus.sum())
    return [math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)))) for t, s in zip(target, corpus, strict=True)]


def _gumbel(doc_id: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(counts: DataFrame, gain: list[int], id_col: str, seed: int = SEED) -> DataFrame:
    """(doc, mark, words, n_features, weight, score) out of ``bucket_counts``."""
    table = F.expr(f"cast(split('{','.join(map(str, gain))}', ',') as array<bigint>)")
    n = F.coalesce(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    total = F.aggregate(F.zip_with("bucket", "n", lambda b, c: F.element_at(table, (b + 1).cast("int")) * c), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = counts.select("doc", "mark", "words", n.alias("n_features"), total.alias("total"))
    # an exact floor of the quotient of two longs
    mean = F.when(F.col("n_features") == 0, 0).otherwise(F.expr("(total - pmod(total, n_features)) div n_features")).cast("long")
    return rows.select("doc", "mark", "words", "n_features", mean.alias("weight"), (mean + _gumbel(F.col("doc").getField(id_col), seed)).cast("long").alias("score"))


def ranked(rows: DataFrame, chosen: Column, order: list[Column], percent: int) -> DataFrame:
    """``rows`` with rank: 1, 2, .. by ``order`` for the first floor(percent / 100 * n) of the n rows where ``chosen`` holds, else null.

    Rows are dealt by range of ``order``; only the sizes of the ranges meet in one place.
    """
    names = rows.columns
    placed = rows.withColumns({"_out": F.when(chosen, 0).otherwise(1), "_tie": F.monotonically_increasing_id()})
    place = [F.col("_out"), *order, F.col("_tie")]
    sorted_rows = placed.repartitionByRange(partitions(rows), *place).sortWithinPartitions(*place).withColumn("_at", F.monotonically_increasing_id())
    held = checkpointed(sorted_rows.select(*names, "_out", "_at"))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("n"), F.count_if(F.col("_out") == 0).alias("chosen"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    n = sizes.agg(F.coalesce(F.sum("chosen"), F.lit(0))).first()[0]
    rank = F.col("_before") + inside + 1
    drawn = n * percent // 100
    out = held.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.select(*names, F.when(rank <= drawn, rank).cast("long").alias("rank"))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    most: int = 1,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
    id_col: str = "doc_id",
    carried: tuple[str, ...] | None = None,
) -> DataFrame:
    """``docs`` with n_features, weight, score and rank: the draw of ``percent`` of the rows of ``least_words`` words or more.

    ``target`` holds the texts of the wanted distribution.  A null or empty text has no words,
    weight 0, and is never drawn.  A null id draws as the empty one.  Rows that share an id keep
    ranks of their own; of rows equal in score and id the smaller hash of the text comes first.
    Rows that are drawn by nothing have a null rank.  An empty target has no features; an empty
    table gives an empty result.  Columns of the four names are replaced.
    """
    counts = bucket_counts(docs, most, buckets, carried=carried)
    gain = gains(merged(bucket_counts(target.select("text"), most, buckets, carried=()), buckets), merged(counts, buckets))
    rows = weighed(counts, gain, id_col, seed)
    doc_id = F.col("doc").getField(id_col)
    out = ranked(rows, F.col("words") >= least_words, [F.desc("score"), doc_id.asc_nulls_last(), F.col("mark")], percent)
    added = ("n_features", "weight", "score", "rank")
    kept = fields(docs if carried is None else docs.select(*[F.col(f"`{c}`") for c in carried]), without=added)
    return out.select(*kept, *added)
