"""Fixed-width binary shards and text lists as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a map record, all little-endian.
MAP_RECORD = (("x", "<i2"), ("y", "<i2"), ("z", "<i2"), ("delta", "<u2"), ("nres", "<u2"), ("fold", "<u2"), ("cls", "<u2"), ("cp", "<u2"))
#: The same fields for maps whose places or lengths outgrow 16 bits.
WIDE_MAP_RECORD = (("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("delta", "<u2"), ("nres", "<u4"), ("fold", "<u2"), ("cls", "<u2"), ("cp", "<u2"))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content) of the binary files under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("shard"), "content")


def fixed_rows(shards: DataFrame, fields: tuple[tuple[str, str], ...], expected: DataFrame | None = None) -> DataFrame:
    """(shard, row, fields..) of records of one width; a shard that isn't whole records is an error.

    ``expected`` (shard, rows) also fixes how many records each shard must hold.
    """
    kind = np.dtype(list(fields))
    shards = shards.join(expected, "shard", "left") if expected is not None else shards.withColumn("rows", F.lit(None).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if len(content) % kind.itemsize or rows is not None and rows * kind.itemsize != len(content):
                    raise ValueError(f"{shard}: {len(content)} bytes are not {rows if rows is not None else 'whole'} records of {kind.itemsize}")
                table = np.frombuffer(content, dtype=kind)
                columns = [pa.array(table[n].astype(np.float64 if np.dtype(t).kind == "f" else np.int64)) for n, t in fields]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(table), pa.string()), pa.array(np.arange(len(table))), *columns], ["shard", "row", *(n for n, _ in fields)])

    types = ", ".join(f"{n} {'double' if np.dtype(t).kind == 'f' else 'long'}" for n, t in fields)
    return shards.select("shard", "content", "rows").mapInArrow(run, f"shard string, row long, {types}")


def map_rows(records: DataFrame, fields: tuple[tuple[str, str], ...] = MAP_RECORD) -> DataFrame:
    """Map records with unknown (the largest number of its field) as null and delta from 0 to 1."""
    known = lambda c: F.when(F.col(c) != int(np.iinfo(dict(fields)[c]).max), F.col(c))
    return records.select("shard", "row", "x", "y", "z", (known("delta") / 65535.0).alias("delta"), *[known(c).alias(c) for c in ("nres", "fold", "cls", "cp")])


def id_lines(files: DataFrame) -> DataFrame:
    """(shard, row, id) of newline-separated names; a last empty line is none."""
    lines = files.select("shard", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("row", "id"))
    return lines.where(F.length("id") > 0).withColumn("row", F.col("row").cast("long"))


def little_endian(value, width: int = 2):
    """An integer column as ``width`` bytes, lowest first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(width)])
