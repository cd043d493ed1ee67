"""Records in shards that are read by byte range, as a Spark data source.

A folder holds shards: ``NAME.records``, records one behind the other, and ``NAME.index``, which has
the offset of each block of ``BLOCK`` rows (64 bits each) and then the length of each row's record
(32 bits, 0 for a row without one).  Rows that lie far apart are stretches of one shard, each with
such a part of the index.  ``shards.json`` lists them with first row, rows, bytes and both places.

    spark.dataSource.register(ShardedRecords)
    spark.read.format("sharded_records").load(path).where("row between 1000 and 1063")

Conditions on ``row`` reach the reader (set spark.sql.python.filterPushdown.enabled), which then
plans the byte ranges of the blocks that can hold such rows, at most ``bytes`` a partition.
Folders are opened through pyarrow, so a path may be of any store that it knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

BLOCK = 64
RANGE_BYTES = 16 << 20
#: Rows without a record that the index steps over rather than lists.
GAP = 16 * BLOCK
_LISTING = "shards.json"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _bytes(store: fs.FileSystem, path: str, start: int = 0, stop: int | None = None) -> bytes:
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read() if stop is None else f.read(stop - start)


def write(records: DataFrame, path: str, shards: int = 8, row: str = "row", record: str = "record") -> None:
    """Writes (row, record), each row at most once, as ``shards`` shards of row ranges; a null record is left out.

    A task writes its shard under the number of its partition, so one that runs again overwrites
    what it wrote before.  The driver writes the list of shards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}"
        store, folder = _store(path)
        rows: list[int] = []
        lengths: list[int] = []
        with store.open_output_stream(f"{folder}/{name}.records") as out:
            for batch in batches:
                for r, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = value.as_buffer()
                    out.write(data)
                    rows.append(r)
                    lengths.append(len(data))
        if not rows:
            return
        place, width = np.array(rows, dtype=np.int64), np.array(lengths, dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(width)])
        ends = np.concatenate([[0], np.flatnonzero(np.diff(place) > GAP) + 1, [len(place)]])
        found, head = [], 0
        with store.open_output_stream(f"{folder}/{name}.index") as out:
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                own = np.zeros(int(place[hi - 1] - place[lo]) + 1, dtype="<u4")
                own[place[lo:hi] - place[lo]] = width[lo:hi]
                base = (starts[lo] + np.concatenate([[0], np.cumsum(own, dtype=np.int64)])[:-1:BLOCK]).astype("<u8")
                data = base.tobytes() + own.tobytes()
                out.write(data)
                found.append((name, int(place[lo]), len(own), int(starts[hi] - starts[lo]), int(starts[lo]), head))
                head += len(data)
        columns = [pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*found, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, ["name", "row0", "rows", "bytes", "start", "head"])

    store, folder = _store(path)
    store.create_dir(folder, recursive=True)
    ordered = records.where(F.col(row).isNotNull() & F.col(record).isNotNull()).select(F.col(row).cast("long").alias("row"), F.col(record).alias("record"))
    found = ordered.repartitionByRange(shards, "row").sortWithinPartitions("row").mapInArrow(run, "name string, row0 long, rows long, bytes long, start long, head long").collect()
    with store.open_output_stream(f"{folder}/{_LISTING}") as out:
        out.write(json.dumps(sorted((r.asDict() for r in found), key=lambda s: s["row0"])).encode())


@dataclass
class Range(InputPartition):
    """Rows row0..row0 + rows - 1 of a stretch of a shard (from its row ``at`` on), where their lengths begin in the index, and the bytes of their records."""

    name: str
    row0: int
    rows: int
    at: int
    head: int
    start: int
    stop: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("bytes", RANGE_BYTES))
        self.low, self.high, self.wanted = 0, (1 << 63) - 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of ``row`` with constants; gives the others back."""
        for f in filters:
            known = getattr(f, "attribute", None) == ("row",)
            if known and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif known and isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif known and isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif known and isinstance(f, In):
                own = {v for v in f.value if v is not None}
                self.wanted = own if self.wanted is None else self.wanted & own
            else:
                yield f

    def _some(self, lo: int, hi: int) -> bool:
        lo, hi = max(lo, self.low), min(hi, self.high)
        return lo <= hi and (self.wanted is None or any(lo <= v <= hi for v in self.wanted))

    def partitions(self) -> list[Range]:
        store, folder = _store(self.path)
        out: list[Range] = []
        for s in json.loads(_bytes(store, f"{folder}/{_LISTING}")):
            if not self._some(s["row0"], s["row0"] + s["rows"] - 1):
                continue
            blocks = -(-s["rows"] // BLOCK)
            start, head = s.get("start", 0), s.get("head", 0)
            base = np.append(np.frombuffer(_bytes(store, f"{folder}/{s['name']}.index", head, head + 8 * blocks), "<u8"), np.uint64(start + s["bytes"])).astype(np.int64)
            for k in range(blocks):
                rows = min(BLOCK, s["rows"] - k * BLOCK)
                if not self._some(s["row0"] + k * BLOCK, s["row0"] + k * BLOCK + rows - 1):
                    continue
                last = out[-1] if out else None
                # a block joins the one before it while the range stays small
                if last and last.name == s["name"] and last.stop == base[k] and last.at + last.rows == k * BLOCK and base[k + 1] - last.start <= self.most:
                    last.rows, last.stop = last.rows + rows, int(base[k + 1])
                else:
                    out.append(Range(s["name"], s["row0"] + k * BLOCK, rows, k * BLOCK, head + 8 * blocks + 4 * k * BLOCK, int(base[k]), int(base[k + 1])))
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        store, folder = _store(self.path)
        width = np.frombuffer(_bytes(store, f"{folder}/{partition.name}.index", partition.head, partition.head + 4 * partition.rows), "<u4").astype(np.int64)
        data = _bytes(store, f"{folder}/{partition.name}.records", partition.start, partition.stop)
        ends = np.cumsum(width)
        row = partition.row0 + np.arange(partition.rows)
        own = (width > 0) & (row >= self.low) & (row <= self.high)
        if self.wanted is not None:
            own &= np.isin(row, list(self.wanted))
        kept = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(row[kept], pa.int64()), pa.array([data[ends[k] - width[k] : ends[k]] for k in kept], pa.binary())], ["row", "record"])


class ShardedRecords(DataSource):
    """The source ``sharded_records``: (row, record) of a folder that ``write`` made; options path and bytes."""

    @classmethod
    def name(cls) -> str:
        return "sharded_records"

    def schema(self) -> str:
        return "row long, record binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options)
