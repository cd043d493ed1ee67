"""Records by byte range, and verdict streams."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from foldlake.queries.structures import _pieces
from foldlake.sources import coordinates, sharded
from foldlake.streaming import verdicts

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = [(r, bytes(rng.randrange(256) for _ in range(rng.randint(1, 40)))) for r in range(5, 3000) if rng.random() < 0.8]
    path = str(tmp_path_factory.mktemp("shards"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(sharded.ShardedRecords)
    shuffled = [*rows, (None, b"x"), (4000, None)]
    rng.shuffle(shuffled)
    sharded.write(spark.createDataFrame(shuffled, "row long, record binary"), path, 4)
    return path, dict(rows)


def test_records_come_back_by_row(spark, folder):
    path, want = folder
    df = spark.read.format("sharded_records").load(path)
    assert {r.row: bytes(r.record) for r in df.collect()} == want
    small = spark.read.format("sharded_records").option("bytes", 500).load(path)
    assert small.rdd.getNumPartitions() > 30 and {r.row: bytes(r.record) for r in small.collect()} == want


@pytest.mark.parametrize("condition", ["row = 700", "row > 2900", "row between 100 and 130", "row in (6, 7, 2500)", "row < 5", "row % 7 = 0 and row >= 2000", "row > 100 and length(record) = 3"])
def test_conditions_select_rows(spark, folder, condition):
    path, want = folder
    got = {r.row for r in spark.read.format("sharded_records").load(path).where(condition).collect()}
    assert got == {r.row for r in spark.createDataFrame(list(want.items()), "row long, record binary").where(condition).collect()}


def test_a_condition_reads_only_its_blocks(folder):
    path, want = folder
    total = sum(map(len, want.values()))

    def planned(*filters):
        reader = sharded.Reader({"path": path})
        left = list(reader.pushFilters(list(filters)))
        return sum(p.stop - p.start for p in reader.partitions()), left

    assert planned()[0] == total
    one, left = planned(EqualTo(("row",), 700))
    assert 0 < one <= 40 * sharded.BLOCK and left == []
    assert planned(GreaterThan(("row",), 100), LessThanOrEqual(("row",), 130))[0] <= 2 * 40 * sharded.BLOCK
    assert planned(In(("row",), (6, 2500)))[0] <= 2 * 40 * sharded.BLOCK
    assert planned(EqualTo(("row",), 100_000))[0] == 0
    other = EqualTo(("record",), b"x")
    assert planned(other) == (total, [other])


def test_packed_coordinates_come_back_from_shards(spark, tmp_path):
    points, book = _pieces(spark, SMALL), coordinates.step_book()
    records = coordinates.packed(points, book, "piece")
    numbered = records.select((records.piece % (1 << 20)).alias("row"), "record")
    sharded.write(numbered, str(tmp_path), 3)
    spark.dataSource.register(sharded.ShardedRecords)
    back = coordinates.unpacked(spark.read.format("sharded_records").load(str(tmp_path)), book, "row")
    want = coordinates.unpacked(numbered, book, "row")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect())) and back.count() == points.count()


def test_verdicts_end_once_and_stay_superseded(spark, tmp_path):
    kind = "request long, generation long, hit string, total long"
    batches = [
        [(1, 1, "a", 2), (2, 7, "x", 2), (3, None, "n", 1)],
        [(1, 2, "c", 3), (1, 1, "b", 2), (2, 7, "x", 2), (2, 7, "y", 2), (2, 7, "y", 2)],
        [(1, 2, "c", 3), (1, 2, "d", 3), (2, 6, "late", 9), (2, 7, "x", 2), (1, 2, "e", 3)],
    ]
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in (tmp_path / "in" / str(k)).glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    query = verdicts.verdict_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    hits = sorted((r.request, r.generation or 0, r.hit) for r in rows if r.kind == "hit")
    assert hits == [(1, 1, "a"), (1, 2, "c"), (1, 2, "d"), (1, 2, "e"), (2, 7, "x"), (2, 7, "y"), (3, 0, "n")]
    assert sorted((r.request, r.generation or 0, r.done, r.hit) for r in rows if r.kind == "end") == [(1, 2, 3, None), (2, 7, 2, None), (3, 0, 1, None)]


def test_the_latest_generation_of_null_requests(spark):
    rows = spark.createDataFrame([("q", 1, "a"), ("q", 3, "b"), ("q", None, "c"), (None, 2, "d"), (None, 1, "e"), ("r", None, "f")], "request string, generation long, hit string")
    assert sorted(r.hit for r in verdicts.latest_generation(rows).collect()) == ["b", "d", "f"]
