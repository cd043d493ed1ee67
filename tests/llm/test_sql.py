"""The queries that SQL can express, against DuckDB on the small tables and on odd rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foldlake.llm.queries import ORACLE, QUERIES
from tests.test_queries import plain

SMALL = "/root/testdata/sf0.001"


def same(df, sql, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if folder != SMALL else ''}')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(plain(x) for x in r) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and abs(x - y) <= 2e-4 for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SMALL), ORACLE[name], SMALL)


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    long = " ".join(f"w{k % 977} x{k % 13}" for k in range(120_000))
    docs = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "one two three four five", "b"), (5, "One two  three four\x0bfive", None), (6, "é 漢字 word", "c"), (7, long, "d"), (8, long + " more", "e"), (30, "one two three four five", "a")]
    docs += [(100 + k, f"shared line\n{k} own words of document {k}\nother line", f"s{k % 14}") for k in range(60)]
    spark.createDataFrame([(i, t, "en", s, None) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "one two three own words of document"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    vectors = [(50 * k, [0.5, float(k), -1.0]) for k in range(4)] + [(k, [k / 7, 1.0, k / 3]) for k in range(1, 40)] + [(300, None), (301, [1.0, None, 1.0]), (302, [float("nan"), 0.0, 0.0]), (303, [float("inf"), 0.0, 0.0]), (350, [1.0]), (351, [2.0]), (304, [])]
    spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<double>, label int").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), "label").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql_on_odd_rows(spark, odd_tables, name):
    same(QUERIES[name](spark, odd_tables), ORACLE[name], odd_tables)
