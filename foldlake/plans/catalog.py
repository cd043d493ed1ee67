"""Named databases: manifests, defaults and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, label string, dims int, structures string, n long, idFormat string, shardBytes long, nprobe int, fanout int, idBytes int"
DEFAULTS = {"nprobe": 16, "fanout": 256, "idBytes": 8, "idFormat": "text"}
#: A table without clusters is scanned as a whole; beyond this many bytes that is refused.
WHOLE_BYTES = 8_000_000


def manifests(texts: DataFrame, column: str = "text") -> DataFrame:
    """Manifest texts to typed rows with defaults; one that can't be read, or has no name, is left out."""
    rows = texts.select(F.from_json(column, MANIFEST, {"mode": "PERMISSIVE"}).alias("m")).select("m.*")
    rows = rows.where("name is not null")
    return rows.select(*[F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in rows.columns])


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return manifests(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def whole_scans(rows: DataFrame, clustered: str = "clusters") -> DataFrame:
    """``rows`` with refused: why a table may not be read as a whole, or null."""
    size = F.col("n") * F.col("dims")
    return rows.withColumn("refused", F.when(F.col(clustered).isNull() & (size > WHOLE_BYTES), F.format_string("%s holds %d bytes of codes; without clusters at most %d are read", "name", size, F.lit(WHOLE_BYTES))))
