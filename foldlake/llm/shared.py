"""Reading tables, cutting lineage, joining skewed keys and mapping whole rows in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

#: A key is hot from this share of the rows on; at most HOT_SHARE keys can be.
HOT_SHARE = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the folder that the cluster names in spark.checkpoint.dir.

    Where none is set, a temporary folder serves a local master; any other master is an error,
    as no executor could read the folder of another machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def spilled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in a new folder beside the checkpoints, which all executors share, and read again."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        checkpointed(spark.range(0))
    path = f"{sc.getCheckpointDir()}/spilled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def narrowed(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """``df`` of about ``rows`` rows in as few tasks as hold ``each`` rows, but enough for every core."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))
    return df.coalesce(n) if n < partitions(df) else df


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def left_join_unique(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join on ``key`` where ``right`` has one row per key and ``size`` holds the key's rows in ``left``.

    Keys that hold at least 1/HOT_SHARE of the ``total`` rows are at most HOT_SHARE and go by a
    broadcast of that proven size.  In the shuffle of the rest their rows, and those of a null
    key, bear a salt that no row of ``right`` has, so no task receives a hot key.  (The salt of
    ``right`` is not written as a constant, which the optimiser would take out of the keys.)
    """
    names = [c for c in right.columns if c != key]
    hot = F.col(size) * HOT_SHARE >= total
    found = right.where(hot).select(F.col(key).alias("_hk"), F.struct(*names).alias("_hot"))
    rest = right.where(~hot).select(F.col(key).alias("_rk"), F.when(F.col(size) < 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("_rs"), F.struct(*names).alias("_rest"))
    out = left.join(F.broadcast(found), left[key] == F.col("_hk"), "left")
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]).bitwiseOR(F.lit(1))
    out = out.withColumn("_ls", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), salt).otherwise(F.lit(0)))
    out = out.join(rest, (F.col(key) == F.col("_rk")) & (F.col("_ls") == F.col("_rs")), "left").withColumn("_got", F.coalesce("_hot", "_rest"))
    return out.select(*left.columns, *(F.col(f"_got.{c}").alias(c) for c in names))


def fields(docs: DataFrame, without: tuple[str, ...] = (), of: str = "doc") -> list[Column]:
    """The columns of ``docs``, whatever their names, out of the struct ``of``."""
    return [F.col(of).getField(c).alias(c) for c in docs.columns if c not in without]


def whole(docs: DataFrame) -> Column:
    """A row of ``docs`` as the struct doc."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def mapped(docs: DataFrame, kernel: Callable[[pa.Array], list[pa.Array]], text: str = "text", **added: DataType) -> DataFrame:
    """(doc, ``added``): each row of ``docs`` as a struct, and what ``kernel`` makes of its text column.

    The kernel sees the texts of a batch and returns one array for each added column; a row is
    never split, joined or moved.
    """
    schema = StructType([StructField("doc", docs.schema), *(StructField(c, t) for c, t in added.items())])
    names = ["doc", *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0)
            yield pa.RecordBatch.from_arrays([doc, *kernel(doc.field(text))], names)

    return docs.select(whole(docs)).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, label: Column, rows: int, most_bytes: int, seed: int) -> DataFrame:
    """(label, text) of a bounded sample to learn from: at most ``rows`` rows and ``most_bytes`` bytes of text.

    ``label`` is an aggregate over the labels of one id.  Ids come in the order of a hash; a
    repeated id gives each of its different texts once.  The order alone decides which rows
    are beyond a bound.  What is returned is checkpointed, so that learning scans it only.
    """
    chosen = labels.where(train & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(label.alias("label")).where("label is not null")
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sizes = texts.select("doc_id", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("bytes")).distinct()
    place = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.col("key")]
    sizes = sizes.orderBy(*place).limit(rows).withColumn("reached", F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy(*place)))
    kept = checkpointed(sizes.where(F.col("reached") <= most_bytes).select("doc_id", "key"))
    own = texts.withColumn("key", F.xxhash64("text")).join(F.broadcast(kept), ["doc_id", "key"])
    return checkpointed(own.groupBy("doc_id", "key").agg(F.first("label").alias("label"), F.first("text").alias("text")).select(F.col("label").cast("int").alias("label"), "text"))
