"""Language identification by rank-order profiles.

Letters are lower-cased, everything else parts words, and a word stands between two spaces.
N-grams are runs of one to three code points of these (a space only at an end).  A language's
profile is its ``PROFILE`` most frequent n-grams over all texts that are learned from, in
order; a document's profile is made alike.  The out-of-place distance adds, for each n-gram of
the document, how far its place is from its place in the language, or ``PROFILE`` where the
language lacks it.  The language of the smallest distance is the prediction.

An n-gram packs into one 63-bit number, so counts are exact.  Tasks count n-grams of slices of
text, Spark adds them up by language, and what reaches the driver is ``PROFILE`` rows for each
of at most ``TOGETHER`` languages; further languages take further turns over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from . import words as W
from .shared import checkpointed, fields

PROFILE = 400
LONGEST = 3
TOGETHER = 512
UNKNOWN = "und"
SLICE = 1 << 20
SALTS = 16

_SPACE = 32
_BITS = 21
#: A text may be cut before any byte that is not a continuation.
_HEADS = np.ones(256, dtype=bool)
_HEADS[128:192] = False


def _points(texts: pa.Array) -> np.ndarray:
    """The code points of texts that follow each other, lower-cased, with one space for each run of anything but letters and marks."""
    low = pa.compute.replace_substring_regex(pa.compute.utf8_lower(texts), pattern=r"[^\p{L}\p{M}]+", replacement=" ")
    data, _ = W.buffers(low)
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32).astype(np.int64), low


def _runs(points: np.ndarray, held: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(first place, packed code) of the n-grams of ``points`` that end behind the first ``held`` places."""
    places, codes = [], []
    padded = np.concatenate([points, np.zeros(LONGEST - 1, dtype=np.int64)])
    n, code, inner = len(points), np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=bool)
    for size in range(1, LONGEST + 1):
        last = padded[size - 1 : size - 1 + n]
        code = code | last << (_BITS * (LONGEST - size))
        # a space may only be at an end, and never alone or next to another
        ok = last > 0
        ok[: max(held - size + 1, 0)] = False
        if size == 1:
            ok &= points != _SPACE
        elif size == 2:
            ok &= (points != _SPACE) | (last != _SPACE)
        else:
            inner |= padded[size - 2 : size - 2 + n] == _SPACE
            ok &= ~inner
        at = np.flatnonzero(ok)
        places.append(at)
        codes.append(code[at])
    return np.concatenate(places), np.concatenate(codes)


def _tally(rows: np.ndarray, codes: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of pairs, by row and code."""
    if not len(rows):
        return rows.astype(np.int64), codes, np.zeros(0, dtype=np.int64)
    at, different = pd.factorize(codes)
    order = np.argsort(different)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    both = rows.astype(np.int64) * len(order) + place[at]
    if weight is None:
        both.sort()
    else:
        turn = np.argsort(both, kind="stable")
        both, weight = both[turn], weight[turn]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    count = np.diff(np.append(first, len(both))) if weight is None else np.add.reduceat(weight, first)
    return both[first] // len(order), different[order][both[first] % len(order)], count


def counted(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(lo, hi, row - lo, code, count) of the n-grams of rows lo..hi; a row beyond ``size`` bytes is counted in pieces."""
    data, offsets = W.buffers(column)
    for lo, hi in W.slices(offsets, size):
        if offsets[hi] - offsets[lo] <= size:
            texts = column.slice(lo, hi - lo).fill_null("")
            points, low = _points(pa.compute.binary_join_element_wise(" ", texts, " ", ""))
            row = np.repeat(np.arange(hi - lo), pa.compute.utf8_length(low).to_numpy(zero_copy_only=False))
            places, codes = _runs(points)
            yield lo, hi, *_tally(row[places], codes)
            continue
        held = np.full(1, _SPACE, dtype=np.int64)
        sums: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 3
        pieces = [p for p in W.chunks(data[offsets[lo] : offsets[hi]], size, _HEADS)]
        for k, piece in enumerate(pieces):
            own, _ = _points(pa.array([piece.tobytes().decode() + (" " if k + 1 == len(pieces) else "")]))
            _, codes = _runs(np.concatenate([held, own]), len(held))
            own_sums = _tally(np.zeros(len(codes), np.int64), codes)
            sums = _tally(*(np.concatenate([a, b]) for a, b in zip(sums, own_sums, strict=True)))
            held = np.concatenate([held, own])[1 - LONGEST :]
        yield lo, hi, *sums


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed over a slice."""
    for batch in batches:
        lang, names = pd.factorize(np.asarray(batch.column(0).to_pylist(), dtype=object))
        for lo, hi, row, code, n in counted(batch.column(1)):
            own, code, n = _tally(lang[lo:hi][row], code, n)
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in own], pa.string()), pa.array(code), pa.array(n)], ["lang", "gram", "n"])


def profiles(docs: DataFrame, train: Column, lang: str = "lang", most: int = PROFILE) -> DataFrame:
    """(lang, gram, place): the ``most`` most frequent n-grams of each language, place 0 first, ties to the smaller code.

    Learned from all rows where ``train`` holds and the language is not null.
    """
    rows = docs.where(train & F.col(lang).isNotNull() & F.col("text").isNotNull()).select(F.col(lang).cast("string").alias("lang"), "text")
    sums = rows.mapInArrow(_learned, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.desc("n"), F.asc("gram")]
    # the best of each part of a language first, so that no task gets all n-grams of one
    sums = sums.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    sums = sums.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= most)
    ranks = sums.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= most)
    return ranks.select("lang", "gram", (F.col("place") - 1).cast("int").alias("place"))


class Profiles:
    """The profiles of some languages: sorted n-grams, and the place of each in each language."""

    def __init__(self, rows: list[tuple[str, int, int]], most: int):
        self.langs = sorted({r[0] for r in rows})
        at = {x: k for k, x in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[1] for r in rows], dtype=np.int64))
        self.places = np.full((len(self.grams), len(self.langs)), 4 * most, dtype=np.int32)
        self.places[np.searchsorted(self.grams, [r[1] for r in rows]), [at[r[0]] for r in rows]] = [r[2] for r in rows]
        self.most = most

    def distances(self, n: int, row: np.ndarray, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of n rows its distance to each language, and the length of its profile."""
        order = np.lexsort((code, -count, row))
        row, code = row[order], code[order]
        begin = np.searchsorted(row, np.arange(n))
        place = np.arange(len(row)) - begin[row]
        row, code, place = row[place < self.most], code[place < self.most], place[place < self.most]
        length = np.bincount(row, minlength=n)
        out = np.repeat(length[:, None] * self.most, len(self.langs), axis=1)
        at = np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)
        known = np.flatnonzero(self.grams[at] == code)
        saved = self.most - np.minimum(np.abs(self.places[at[known]] - place[known, None]), self.most)
        for k in range(len(self.langs)):
            out[:, k] -= np.bincount(row[known], saved[:, k], minlength=n).astype(np.int64)
        return out, length


def _judged(model: Profiles):
    """(doc, text, lang_pred, distance, length) with the nearer of the language so far and those of ``model``; ties to the former."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1)
            lang, far = batch.column(2).to_pylist(), batch.column(3).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).copy()
            size = np.zeros(batch.num_rows, dtype=np.int64)
            lettered = pa.compute.match_substring_regex(text, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, row, code, n in counted(text):
                found, length = model.distances(hi - lo, row, code, n)
                size[lo:hi] = length
                best = found.argmin(axis=1)
                least = found[np.arange(hi - lo), best]
                for k in np.flatnonzero(lettered[lo:hi] & (least < far[lo:hi])):
                    lang[lo + k] = model.langs[best[k]]
                far[lo:hi] = np.minimum(far[lo:hi], least)
            yield pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(lang, pa.string()), pa.array(far), pa.array(size)], ["doc", "text", "lang_pred", "distance", "length"])

    return run


def identified(docs: DataFrame, profile: DataFrame, most: int = PROFILE, together: int = TOGETHER, carried: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score: 1 - distance over the largest distance that its profile could have.

    ``profile`` is that of ``profiles``.  A text that is null or has no letter gets ``und`` and
    score 0, as does every text if nothing was learned; equal distances go to the language of
    the smaller name.  Every row is judged alone.  ``carried`` names the columns to keep (all,
    if None); those of the two names are replaced.
    """
    names = docs.columns if carried is None else list(carried)
    own = StructType([docs.schema[c] for c in names])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), "text", F.lit(UNKNOWN).alias("lang_pred"), F.lit(None).cast("long").alias("distance"), F.lit(0).cast("long").alias("length"))
    schema = StructType([StructField("doc", own), StructField("text", StringType()), StructField("lang_pred", StringType()), StructField("distance", LongType()), StructField("length", LongType())])
    profile = checkpointed(profile)
    last = None
    while True:
        some = profile if last is None else profile.where(F.col("lang") > last)
        langs = [r[0] for r in some.select("lang").distinct().orderBy("lang").limit(together).collect()]
        if not langs:
            break
        model = Profiles([tuple(r) for r in some.where(F.col("lang") <= langs[-1]).collect()], most)
        rows = (rows if last is None else checkpointed(rows)).mapInArrow(_judged(model), schema)
        last = langs[-1]
    share = F.when((F.col("lang_pred") == UNKNOWN) | (F.col("length") == 0), 0.0).otherwise(1 - F.col("distance") / (F.col("length") * most))
    kept = fields(docs.select(*[F.col(f"`{c}`") for c in names]), without=("lang_pred", "score"))
    return rows.select(*kept, "lang_pred", share.cast(DoubleType()).alias("score"))
