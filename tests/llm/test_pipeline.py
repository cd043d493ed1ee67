"""The pipeline's stages, on tables with planted cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import DOCS, vocabulary


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    words = vocabulary(400, 21)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, say(30)) for k in range(8)]
    rows, labels = [], []
    for i in range(400):
        text = "\n".join(say(25) + "." for _ in range(4))
        if i % 8 == 0:
            text += f"\n{say(4)} vileword {say(4)}."
        if i % 2:
            text = "a line that every site has\n" + text
        labels.append((i, 1, int(i % 8 == 0)))
        rows.append([i, text, "en", f"s{i // 2 % 12}", len(text)])
    rows[101][1] = rows[11][1]
    rows[103][1] = rows[13][1] + " more"
    rows[105][1] += "\n" + items[3][1]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([tuple(r) for r in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_decision_takes_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert len(seen["toxicity"]) >= 345 and sum(i % 8 == 0 for i in seen["toxicity"]) <= 4
    assert sum("every site" in t for t in seen["line dedup"].values()) == 1 and seen["line dedup"].keys() == seen["toxicity"].keys()
    gone = seen["line dedup"].keys() - seen["near-duplicates"].keys()
    assert gone == {101, 103}
    assert seen["near-duplicates"].keys() - seen["decontamination"].keys() == {105}
    assert seen["mixing"].keys() <= seen["decontamination"].keys()
    assert docs.count() > len(seen["decontamination"])


def test_run_is_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "text", "shard", "copy"} <= set(out.columns) and out.count() > 300
    again = corpus_pipeline.run(spark, folder)
    assert out.select("doc_id", "copy").exceptAll(again.select("doc_id", "copy")).count() == 0


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_rows_without_an_own_id_are_kept_by_their_texts(spark, folder):
    words = vocabulary(400, 33)
    rng = random.Random(33)
    a, b, c, d, e, f, g = (" ".join(rng.choice(words) for _ in range(60)) for _ in range(7))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, e), (3, e), (3, f), (4, f + " more"), (5, g), (None, g), (6, g), (6, g), (None, None), (None, ""), (7, ""), (7, " ")]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", None) for k, (i, t) in enumerate(rows)], DOCS)
    out = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, folder)
    assert out.columns == docs.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
    kept = [(None, a), (None, b), (1, c), (1, d), (2, e), (3, f), (5, g), (None, None), (None, ""), (7, ""), (7, " ")]
    assert got == sorted((str(i), str(t)) for i, t in kept)
    source = {r.source for r in out.where("text = '" + b + "'").collect()}
    assert source == {"s1"}


def test_columns_of_any_name_pass_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60")
    extra = ["a.b", "leaks", "toxic_score", "offending", "text_key", "doc", "_n_removed", "shard", "size"]
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in extra])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name == "mixing":
            extra.remove("shard")
            assert docs.columns[-2:] == ["shard", "copy"]
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)


def test_a_long_clean_document_stays(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = " ".join(r.text for r in docs.where("doc_id % 8 <> 0").orderBy("doc_id").collect())
    long = spark.createDataFrame([(9001, clean * 20, "en", "s1", len(clean) * 20), (9002, "the weather is fine today. " * 20_000, "en", "s1", 540_000)], DOCS)
    assert len(clean) * 20 > 1_000_000
    kept = corpus_pipeline.reject_toxic(spark, docs.union(long), folder)
    assert {r.doc_id for r in kept.where("doc_id >= 9000").select("doc_id").collect()} == {9001, 9002}
