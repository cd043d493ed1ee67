"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence has the probability sigmoid(b + sum of the weights
of its distinct words and word stems), and 0 if it has none of the learned ones; a document the
noisy-or 1 - prod(1 - p).  Only document labels train the weights; the same weights then point
at the offending sentences.

A score counts the sentences that are likelier toxic than not: thousands of unlikely ones would
add up to a toxic text out of its length alone.  A text without any has the probability of its
likeliest sentence.  So a score of 0.5 or more always comes with an offending sentence.

Training reads at most ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` of their text, the first
by a hash of the id.  Words are hashed to ``BUCKETS`` places, so the model has one size
whatever the corpus.  Spark counts the documents of each place by label; of the sample the
driver gets, for each sentence, only the at most ``FEATURES`` places that tell labels apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import DoubleType

from . import words as W
from .shared import fields, labelled_sample, mapped

SAMPLE, SAMPLE_BYTES = 6000, 128 << 20
BUCKETS = 1 << 18
FEATURES = 4096
STEMS = (4, 6, 8)

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[10, 33, 46, 63]] = True
_GAPS = np.ones(256, dtype=bool)
_GAPS[[39, *range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    bias: float
    weights: np.ndarray


def _bags(data: np.ndarray, offsets: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (sentence, bucket) pairs of a slice, and the sentence at which each row begins.

    A sentence ends behind one of . ! ? or a line feed, and at the end of its row.  A word gives
    its own bucket and one for each of its first ``STEMS`` bytes; ``used`` leaves out the rest.
    """
    ends = _ENDS[data]
    number = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(ends, out=number[1:])
    first = number[offsets] + np.arange(len(offsets))
    low = W.LOWER[data]
    starts, stops = W.bounds(low, offsets, _GAPS)
    row = np.searchsorted(offsets, starts, side="right") - 1
    sentence = number[starts] + row
    hashes = W.span_hasher(low)
    pairs = []
    for k, stem in enumerate((0, *STEMS)):
        long = slice(None) if not stem else stops - starts > stem
        ends = stops[long] if not stem else starts[long] + stem
        bucket = ((hashes(starts[long], ends) >> np.uint64(40)).astype(np.int64) + 7919 * k) & (BUCKETS - 1)
        own = sentence[long] * BUCKETS + bucket
        pairs.append(own if used is None else own[used[bucket]])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // BUCKETS, pairs % BUCKETS, first


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (lo, hi, bytes, offsets); a very long text comes in several, each with its row, cut behind sentence ends."""
    data, offsets = W.buffers(column)
    for lo, hi in W.slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        if hi == lo + 1 and len(part) > W.SLICE_BYTES:
            for piece in W.chunks(part, gaps=_ENDS, behind=True):
                yield lo, hi, piece, np.array([0, len(piece)])
        else:
            yield lo, hi, part, offsets[lo : hi + 1] - offsets[lo]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (bucket, pos, neg): in how many texts of either label a bucket is, summed over a task."""
    counts = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        label = batch.column(0).to_numpy()
        held: dict[int, list[np.ndarray]] = {}
        for lo, hi, data, offsets in _pieces(batch.column(1)):
            sentence, bucket, first = _bags(data, offsets)
            at = np.searchsorted(sentence, first)
            for k in range(lo, hi):
                held.setdefault(k, []).append(np.unique(bucket[at[k - lo] : at[k - lo + 1]]))
        for k, own in held.items():
            counts[int(label[k] > 0), np.unique(np.concatenate(own))] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1, seen]), pa.array(counts[0, seen])], ["bucket", "pos", "neg"])


def _examples(place: np.ndarray):
    """(label, text) to (label, sentence, feature): sentences with a feature, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = place >= 0
        for batch in batches:
            n = batch.num_rows
            seen = np.zeros(n, dtype=np.int64)
            pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
            for lo, hi, data, offsets in _pieces(batch.column(1)):
                sentence, bucket, first = _bags(data, offsets, used)
                at = np.searchsorted(sentence, first)
                for k in range(lo, hi):
                    own, number = np.unique(sentence[at[k - lo] : at[k - lo + 1]], return_inverse=True)
                    pairs[k].append((number + seen[k], place[bucket[at[k - lo] : at[k - lo + 1]]]))
                    seen[k] += len(own)
            lists = [[np.concatenate([p[j] for p in own]).astype(np.int32) if own else [] for own in pairs] for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in lists)], ["label", "sentence", "feature"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES, turns: int = 400) -> Model:
    """Weights learned from ``labels`` (doc_id, toxic) on the rows where ``train`` (over doc_id) holds.

    Rows whose label or id is null are left out, a repeated id counts with its largest label,
    once for each of its different texts.  Without labels of both kinds every score is 0.
    """
    chosen = labelled_sample(docs, labels, train, F.max("toxic"), sample, most_bytes, 10)
    p, q = chosen.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") <= 0)).first()
    if not p or not q:
        return Model(-1e6, np.zeros(BUCKETS, dtype=np.float32))
    # words by the log-likelihood ratio of their presence in toxic documents
    counts = chosen.mapInArrow(_presence, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts.column("bucket").to_numpy()
    pos[at], neg[at] = counts.column("pos").to_numpy(), counts.column("neg").to_numpy()
    rate, expected = (pos + neg) / (p + q), lambda x, n: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(n, 1e-9)), 0)
    gain = expected(pos, rate * p) + expected(neg, rate * q) + expected(p - pos, (1 - rate) * p) + expected(q - neg, (1 - rate) * q)
    gain = np.where((pos + neg >= 3) & (gain > 6), gain, 0)
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    best = best[gain[best] > 0]
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[best] = np.arange(len(best))
    rows = chosen.mapInArrow(_examples(place), "label int, sentence array<int>, feature array<int>")
    rows = rows.toArrow()
    ends = np.cumsum(pa.compute.list_value_length(rows.column("feature")).to_numpy())
    flat = [rows.column(c).combine_chunks().flatten().to_numpy() for c in ("feature", "sentence")]
    spans = list(zip(rows.column("label").to_pylist(), np.append(0, ends[:-1]), ends, strict=True))
    rows = rows.take(sorted(range(len(spans)), key=lambda k: (spans[k][0], *(x[spans[k][1] : spans[k][2]].tobytes() for x in flat))))
    label = rows.column("label").to_numpy().astype(np.float64)
    lengths = pa.compute.list_value_length(rows.column("feature")).to_numpy()
    feature, number = (rows.column(c).combine_chunks().flatten().to_numpy() for c in ("feature", "sentence"))
    ends = np.cumsum(lengths)
    sizes = np.array([number[e - n : e].max() + 1 if n else 0 for e, n in zip(ends, lengths, strict=True)], dtype=np.int64)
    sentence = number + np.repeat(np.cumsum(sizes) - sizes, lengths)
    owner = np.repeat(np.arange(len(label)), sizes)
    theta = np.zeros(len(best) + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, turns + 1):
        z = theta[-1] + np.bincount(sentence, theta[feature], minlength=len(owner))
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.bincount(owner, np.log1p(-np.minimum(s, 1 - 1e-9)), minlength=len(label))
        some = np.maximum(-np.expm1(none), 1e-9)
        # d loss / d z of a sentence, spread from its document
        pull = np.where(label > 0, -np.exp(none) / some, 1.0)[owner] * s
        grad = np.append(np.bincount(feature, pull[sentence], minlength=len(best)), pull.sum()) / len(label)
        grad[:-1] += 2e-5 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[best] = theta[:-1]
    return Model(float(theta[-1]), weights)


_OFFENDING = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scored(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """(doc, toxic_score, offending): each row as a struct, with what ``toxicity`` says of it."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))

    def kernel(text: pa.Array) -> list[pa.Array]:
        bias, weights = shared.value
        used = weights != 0
        clean, likeliest = np.zeros(len(text)), np.zeros(len(text))
        found: list[list] = [[] for _ in range(len(text))]
        chars = np.zeros(len(text), dtype=np.int64)
        for lo, hi, data, offsets in _pieces(text):
            sentence, bucket, first = _bags(data, offsets, used)
            z = bias + np.bincount(sentence, weights[bucket], minlength=first[-1])
            s = np.where(np.bincount(sentence, minlength=first[-1]) > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            logs = np.where(s >= cut, np.log1p(-np.minimum(s, 1 - 1e-12)), 0.0)
            clean[lo:hi] += np.add.reduceat(logs, first[:-1]) if hi > lo else 0
            likeliest[lo:hi] = np.maximum(likeliest[lo:hi], np.maximum.reduceat(s, first[:-1]) if hi > lo else 0)
            width = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=width[1:])
            hits = np.flatnonzero(s >= cut)
            if len(hits):
                stops = np.flatnonzero(_ENDS[data]) + 1
                row = np.searchsorted(first, hits, side="right") - 1
                for k, r in zip(hits, row, strict=True):
                    j = int(k - r)
                    start = max(int(stops[j - 1]) if j else 0, int(offsets[r]))
                    end = min(int(stops[j]) if j < len(stops) else len(data), int(offsets[r + 1]))
                    base = chars[lo + r] - width[offsets[r]]
                    found[lo + r].append({"start": int(width[start] + base), "end": int(width[end] + base), "score": float(s[k])})
            chars[lo:hi] += width[offsets[1:]] - width[offsets[:-1]]
        return [pa.array(np.where(clean < 0, -np.expm1(clean), likeliest)), pa.array(found, _OFFENDING)]

    return mapped(docs, kernel, toxic_score=DoubleType(), offending=from_arrow_type(_OFFENDING))


def toxicity(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """``docs`` with toxic_score (0 to 1) and offending, its sentences of probability >= ``cut``.

    offending: array of (start, end, score), code points, end exclusive.  A text without a
    learned word, a null one too, has score 0.  Nulls, ties and repeated rows change nothing else,
    since a row is scored alone.  Columns of these two names are replaced; all others keep
    their names and values.
    """
    return scored(docs, model, cut).select(*fields(docs, without=("toxic_score", "offending")), "toxic_score", "offending")
