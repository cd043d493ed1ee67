"""Packed coordinate records and half floats.

A record holds a float32 centre, a 16-bit count, three anchors as 16-bit hundredths, and then
for each residue an 11-bit code, most significant bit first: a step of a codebook in the frame
of the three residues before, or the largest code and three 16-bit hundredths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, SCALE, ANCHORS = 11, 100, 3
ESCAPE = (1 << BITS) - 1


def codebook_id(book: bytes | Column):
    """The first 16 hex digits of a codebook's SHA-256."""
    return F.substring(F.sha2(book, 256), 1, 16)


def step_book(size: int = ESCAPE, length: float = 3.8, seed: int = 3) -> np.ndarray:
    """Steps spread evenly over a sphere: a codebook without training data."""
    k = np.arange(size) + 0.5
    z = 1 - 2 * k / size
    turn = np.pi * (1 + 5**0.5) * (k + seed)
    r = np.sqrt(1 - z * z)
    return length * np.stack([r * np.cos(turn), r * np.sin(turn), z], axis=1)


def _frames(p: np.ndarray) -> np.ndarray:
    """(records, 3, 3): axes along the last step, across the bend and normal to both; p is (records, 3 points, 3)."""
    u = p[:, 2] - p[:, 1]
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    back = p[:, 1] - p[:, 0]
    w = back - (back * u).sum(axis=1, keepdims=True) * u
    flat = np.linalg.norm(w, axis=1) < 1e-8
    if flat.any():
        axis = np.where(np.abs(u[flat, :1]) < 0.9, np.array([[1.0, 0, 0]]), np.array([[0, 1.0, 0]]))
        w[flat] = axis - (axis * u[flat]).sum(axis=1, keepdims=True) * u[flat]
    w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
    return np.stack([u, w, np.cross(u, w)], axis=1)


def encode(points: np.ndarray, book: np.ndarray, worst: float = 0.5) -> bytes:
    """One record of (n, 3) points; a step that no code meets within ``worst`` is written out."""
    centre = points.mean(axis=0).astype(np.float32) if len(points) else np.zeros(3, np.float32)
    own = points - centre.astype(np.float64)
    head = centre.astype("<f4").tobytes() + np.uint16(len(points)).astype("<u2").tobytes()
    anchors = np.floor(own[:ANCHORS] * SCALE + 0.5).astype("<i2")
    kept = np.zeros_like(own)
    kept[:ANCHORS] = anchors / SCALE
    bits: list[str] = []
    for i in range(ANCHORS, len(own)):
        frame = _frames(kept[None, i - 3 : i])[0]
        guesses = kept[i - 1] + book @ frame
        gap = ((guesses - own[i]) ** 2).sum(axis=1)
        code = int(np.argmin(gap))
        if gap[code] <= worst * worst:
            kept[i] = guesses[code]
            bits.append(format(code, f"0{BITS}b"))
        else:
            raw = np.floor(own[i] * SCALE + 0.5).astype(np.int16)
            kept[i] = raw / SCALE
            bits.append("1" * BITS + "".join(format(int(x) & 0xFFFF, "016b") for x in raw))
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return head + anchors.tobytes() + bytes(int(text[k : k + 8], 2) for k in range(0, len(text), 8))


def decode(records: list[bytes], book: np.ndarray) -> list[np.ndarray]:
    """Points of many records; residue by residue, all records at once."""
    if not records:
        return []
    n = np.array([int.from_bytes(r[12:14], "little") for r in records])
    centre = np.array([np.frombuffer(r[:12], "<f4") for r in records], dtype=np.float64)
    out = np.zeros((len(records), max(int(n.max()), ANCHORS), 3))
    body = []
    for k, r in enumerate(records):
        a = min(ANCHORS, int(n[k]))
        out[k, :a] = np.frombuffer(r[14 : 14 + 6 * a], "<i2").reshape(a, 3) / SCALE
        body.append(np.unpackbits(np.frombuffer(r[14 + 6 * a :], dtype=np.uint8)))
    bits = np.zeros((len(records), max(map(len, body)) + 64), dtype=np.int64)
    for k, b in enumerate(body):
        bits[k, : len(b)] = b
    at = np.zeros(len(records), dtype=np.int64)

    def take(rows: np.ndarray, width: int) -> np.ndarray:
        got = bits[rows[:, None], at[rows][:, None] + np.arange(width)] @ (1 << np.arange(width)[::-1])
        at[rows] += width
        return got

    for i in range(ANCHORS, int(n.max())):
        rows = np.flatnonzero(n > i)
        code = take(rows, BITS)
        step = code != ESCAPE
        r = rows[step]
        if len(r):
            frame = _frames(out[r, i - 3 : i].copy())
            out[r, i] = out[r, i - 1] + np.einsum("rk,rkc->rc", book[code[step]], frame)
        r = rows[~step]
        for c in range(3):
            if len(r):
                raw = take(r, 16)
                out[r, i, c] = np.where(raw > 32767, raw - 65536, raw) / SCALE
    return [out[k, : n[k]] + centre[k] for k in range(len(records))]


def unpacked(records: DataFrame, book: np.ndarray, key: str, column: str = "record") -> DataFrame:
    """(key, i, x, y, z) of a table of binary records; the codebook is of a fixed size and travels with the task."""
    shared = records.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = decode(batch.column(1).to_pylist(), shared.value)
            n = [len(p) for p in points]
            flat = np.concatenate(points) if points else np.zeros((0, 3))
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
            i = np.concatenate([np.arange(k) for k in n]).astype(np.int32) if n else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.array(i), *[pa.array(flat[:, c]) for c in range(3)]], [key, "i", "x", "y", "z"])

    kind = records.schema[key].dataType.simpleString()
    return records.select(key, column).mapInArrow(run, f"`{key}` {kind}, i int, x double, y double, z double")


def packed(points: DataFrame, book: np.ndarray, key: str) -> DataFrame:
    """(key, record): one binary record for each chain."""
    shared = points.sparkSession.sparkContext.broadcast(book)
    chains = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "z"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array([[p["x"], p["y"], p["z"]] for p in chain]).reshape(-1, 3) for chain in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(r, shared.value) for r in rows], pa.binary())], [key, "record"])

    kind = points.schema[key].dataType.simpleString()
    return chains.mapInArrow(run, f"`{key}` {kind}, record binary")


def half_float(code: Column) -> Column:
    """The value of a 16-bit float given as an integer of 0 to 65535."""
    sign = F.when(code.bitwiseAND(F.lit(0x8000)) != 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(code, 10).bitwiseAND(F.lit(31)), code.bitwiseAND(F.lit(1023))
    return (
        F.when(exponent == 0, sign * fraction * 2.0**-24)
        .when(exponent == 31, F.when(fraction == 0, sign * float("inf")).otherwise(F.lit(float("nan"))))
        .otherwise(sign * (1 + fraction / 1024.0) * F.pow(F.lit(2.0), exponent - 15))
    )
