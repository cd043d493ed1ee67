"""A training corpus from documents: stages in order, each a function of (spark, docs, sf_dir).

Every stage but the last returns the columns of ``documents``, whatever their names.  Rows
without an id, and rows that share one, are rows of their own in every stage; the
near-duplicate stage tells them apart by their texts.  ``run`` cuts the lineage after each
stage, so no stage computes another's work again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldlake.llm import decontamination, mixing, toxicity
from foldlake.llm.line_dedup import cleaned
from foldlake.llm.near_duplicates import one_of_each
from foldlake.llm.queries import HELD_OUT
from foldlake.llm.shared import checkpointed, crc_mod, fields, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC`` by sentences; learned as in the query of this operator."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), HELD_OUT) != 0)
    return toxicity.scored(docs, model).where(F.col("toxic_score") < TOXIC).select(*fields(docs))


def remove_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of many sites; a document that loses every line goes."""
    out = cleaned(docs)
    touched = F.col("n_removed") > 0
    out = out.where(~F.coalesce(touched & (F.expr("trim(BOTH ' \t\r\n' FROM text)") == ""), F.lit(False)))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(touched, length).otherwise(F.col("doc").getField("n_chars"))
    return out.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, by five-word shingles: that of the smallest id, null last."""
    return one_of_each(docs, size=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(*fields(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: documents with their output shard and copy, shuffled in each shard."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_shared_lines),
    ("near-duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned scores and seeded draws are not expressible in SQL; tests hold stages against brute force.
ORACLE_SQL = None
