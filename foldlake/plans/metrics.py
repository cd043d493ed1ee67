"""What a job reads, counted while it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str, *sized: str) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its rows and of the bytes of its string or binary columns ``sized``.

    The figures are there once an action has run over the frame; no second pass is made.
    """
    seen = Observation(name)
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in sized), F.lit(0))
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), seen
