"""Quality by a sparse rule ensemble.

Boosted trees of depth ``DEPTH`` over text statistics give their paths as conjunctive rules;
a lasso-penalised logistic regression keeps a few of them, and the kept rules become one
Spark column expression over the statistics.

Statistics are taken over whole texts in Arrow batches.  Fitting learns from at most
``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` of their text, the first by a hash of the id;
what reaches the driver is their statistics, a fixed number of doubles each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import labelled_sample

SAMPLE, SAMPLE_BYTES = 8000, 256 << 20
TREES, DEPTH, BINS = 40, 3, 32
PENALTY = 0.002

STATISTICS = (
    "log_words",
    "word_bytes",
    "upper_share",
    "digit_share",
    "punctuation_share",
    "symbols_per_word",
    "pipes_per_word",
    "shouts_per_word",
    "repeat_share",
    "distinct_share",
    "words_per_line",
    "distinct_line_share",
    "stops_per_word",
)


def _lut(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters.encode())] = True
    return out


_CLASSES = (
    _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _lut("abcdefghijklmnopqrstuvwxyz"),
    _lut("0123456789"),
    _lut("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"),
    _lut("#$%&*+<=>@\\^_`{}~[]"),
    _lut("|"),
    _lut("!"),
    _lut(".?"),
)
_LINE = _lut("\n\r")


class _Spans:
    """Sorted distinct hashes of one text over its slices; merged as they grow, so memory follows the distinct ones."""

    def __init__(self) -> None:
        self.known, self.fresh = np.zeros(0, np.uint64), []

    def add(self, hashes: np.ndarray) -> None:
        self.fresh.append(np.unique(hashes))
        if sum(map(len, self.fresh)) > len(self.known):
            self.merge()

    def merge(self) -> int:
        self.known, self.fresh = np.unique(np.concatenate([self.known, *self.fresh])), []
        return len(self.known)


def _distinct(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    own = W.mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(own, return_index=True)[1]
    return np.bincount(row[first], minlength=rows)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 8 + 7) counts of whole texts."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 15))
    for k, lut in enumerate(_CLASSES):
        total = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(lut[data], out=total[1:])
        out[:, k] = total[offsets[1:]] - total[offsets[:-1]]
    starts, ends = W.bounds(data, offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    hashes = W.span_hasher(data)
    word = hashes(starts, ends)
    same = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    out[:, 8] = np.bincount(row, minlength=rows)
    out[:, 9] = np.bincount(row, ends - starts, minlength=rows)
    out[:, 10] = _distinct(row, word, rows)
    out[:, 11] = np.bincount(row[1:][same], minlength=rows)
    starts, ends = W.bounds(data, offsets, _LINE)
    row = np.searchsorted(offsets, starts, side="right") - 1
    out[:, 12] = np.bincount(row, minlength=rows)
    out[:, 13] = _distinct(row, hashes(starts, ends), rows)
    out[:, 14] = np.diff(offsets)
    return out


def _long_counts(data: np.ndarray) -> np.ndarray:
    """The counts of one text, slice by slice: sums, and the distinct words and lines of all its slices.

    Slices end at white space, so no word is cut; a line that crosses slices is hashed as one.
    """
    out, words, lines = np.zeros(15), _Spans(), _Spans()
    last = np.zeros(0, np.uint64)
    line, reach = np.zeros(0, np.uint64), 0  # the line that is open at the end of a slice, and its bytes
    for piece in W.chunks(data):
        offsets = np.array([0, len(piece)])
        for k, lut in enumerate(_CLASSES):
            out[k] += np.count_nonzero(lut[piece])
        sums = W.span_sums(piece)
        starts, ends = W.bounds(piece, offsets)
        word = W.mix(sums(starts, ends))
        both = np.concatenate([last, word])
        out[8] += len(word)
        out[9] += (ends - starts).sum()
        out[11] += np.count_nonzero(both[1:] == both[:-1])
        words.add(word)
        last = both[-1:]
        starts, ends = W.bounds(piece, offsets, _LINE)
        own, size = sums(starts, ends), ends - starts
        if reach and len(starts) and starts[0] == 0:
            own[0] = W.joined_sums(line, reach, own[:1])[0]
            size[0] += reach
        else:
            own, size = np.concatenate([line, own]), np.concatenate([np.full(len(line), reach), size])
        cut = len(own) - int(len(ends) and ends[-1] == len(piece))
        line, reach = own[cut:], int(size[cut:].sum())
        out[12] += cut
        lines.add(W.mix(own[:cut]))
    out[12] += len(line)
    lines.add(W.mix(line))
    out[10], out[13], out[14] = words.merge(), lines.merge(), len(data)
    return out


def _statistics(c: np.ndarray) -> np.ndarray:
    upper, lower, digits, marks, symbols, pipes, shouts, stops, words, word_bytes, distinct, repeats, lines, own_lines, size = c.T
    w, n = np.maximum(words, 1), np.maximum(size, 1)
    return np.stack(
        [
            np.log1p(words),
            word_bytes / w,
            upper / np.maximum(upper + lower, 1),
            digits / n,
            marks / n,
            symbols / w,
            pipes / w,
            shouts / w,
            repeats / w,
            distinct / w,
            words / np.maximum(lines, 1),
            own_lines / np.maximum(lines, 1),
            stops / w,
        ],
        axis=1,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.buffers(batch.column(batch.num_columns - 1))
        counts = np.zeros((batch.num_rows, 15))
        for lo, hi in W.slices(offsets):
            part = data[offsets[lo] : offsets[hi]]
            if hi == lo + 1 and len(part) > W.SLICE_BYTES:
                counts[lo] = _long_counts(part)
            else:
                counts[lo:hi] = _counts(part, offsets[lo : hi + 1] - offsets[lo])
        found = _statistics(counts)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[:, k]) for k in range(len(STATISTICS)))], [*batch.schema.names[:-1], *STATISTICS])


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and a double for each of STATISTICS; a null text counts as empty."""
    held = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("__read"))
    types = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{s} double" for s in STATISTICS]
    return held.mapInArrow(_measure, ", ".join(types))


Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    """bias, and for each rule its weight; a rule is a conjunction of (statistic, above, threshold)."""

    bias: float
    rules: list[tuple[float, Rule]]

    def score(self) -> Column:
        """The probability of label 1 as a column over STATISTICS."""

        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, [F.col(STATISTICS[k]) > t if above else F.col(STATISTICS[k]) <= t for k, above, t in rule])

        z = reduce(lambda a, b: a + b, [F.when(holds(rule), F.lit(w)).otherwise(F.lit(0.0)) for w, rule in self.rules], F.lit(self.bias))
        return 1 / (1 + F.exp(-z))


def _grow(binned: np.ndarray, edges: list[np.ndarray], pull: np.ndarray, weight: np.ndarray) -> tuple[list[tuple[Rule, np.ndarray]], np.ndarray]:
    """Every node of one tree as (rule, rows), and the Newton step of the leaf of each row."""
    nodes, step = [], np.zeros(len(pull))
    front: list[tuple[Rule, np.ndarray]] = [((), np.arange(len(pull)))]
    while front:
        rule, rows = front.pop()
        g, h = pull[rows].sum(), weight[rows].sum()
        best = (1e-3, None)
        if len(rule) < DEPTH and len(rows) >= 20:
            for k in range(binned.shape[1]):
                b = binned[rows, k]
                gl, hl, n = (np.cumsum(np.bincount(b, x, minlength=BINS))[:-1] for x in (pull[rows], weight[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(n < 8) | (len(rows) - n < 8)] = 0
                gain[len(edges[k]) :] = 0
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (gain[at], (k, at))
        if best[1] is None:
            step[rows] = g / (h + 1)
            continue
        k, at = best[1]
        for above in (False, True):
            part = rows[(binned[rows, k] > at) == above]
            grown = (*rule, (k, above, float(edges[k][at])))
            nodes.append((grown, part))
            front.append((grown, part))
    return nodes, step


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Ensemble:
    """Rules learned from ``labels`` (doc_id, quality) on the rows where ``train`` (over doc_id) holds.

    Rows with a null label or id are left out, a repeated id counts with its smallest label,
    once for each of its different texts.  Without labels of both kinds every score is 0.5.
    """
    chosen = labelled_sample(docs, labels, train, F.min("quality"), sample, most_bytes, 9)
    rows = statistics(chosen, "label").toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    y, x = rows["label"].to_numpy(dtype=np.float64), rows[list(STATISTICS)].to_numpy()
    if not 0 < y.sum() < len(y):
        return Ensemble(0.0, [])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[Rule, np.ndarray] = {}
    rng = np.random.default_rng(9)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        part = rng.random(len(y)) < 0.7
        nodes, step = _grow(binned, edges, (y - p) * part, np.maximum(p * (1 - p), 1e-6) * part)
        z += 0.3 * np.clip(step, -4, 4)
        for rule, rows_in in nodes:
            if rule not in found and 0.005 * len(y) <= len(rows_in) <= 0.995 * len(y):
                found[rule] = rows_in
    rules = list(found)
    a = np.zeros((len(y), len(rules)))
    for j, rule in enumerate(rules):
        a[found[rule], j] = 1
    center, scale = a.mean(axis=0), np.maximum(a.std(axis=0), 0.05)
    a = (a - center) / scale
    weights, bias = np.zeros(len(rules)), np.log(y.mean() / (1 - y.mean()))
    rate = 1 / (0.25 * np.linalg.norm(a, 2) ** 2 / len(y) + 0.25)
    ahead, momentum = weights.copy(), 1.0
    for _ in range(600):
        p = 1 / (1 + np.exp(-(a @ ahead + bias)))
        bias -= rate * (p - y).mean()
        new = ahead - rate * (a.T @ (p - y)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * PENALTY, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, weights, momentum = new + (momentum - 1) / following * (new - weights), new, following
    kept = np.flatnonzero(weights)
    w = weights / scale
    return Ensemble(float(bias - (w * center).sum()), [(float(w[j]), rules[j]) for j in kept])


def quality(docs: DataFrame, model: Ensemble, *keep: str) -> DataFrame:
    """The columns ``keep``, STATISTICS and quality_score (0 to 1) of every row; each row is scored alone."""
    return statistics(docs, *keep).withColumn("quality_score", model.score())
