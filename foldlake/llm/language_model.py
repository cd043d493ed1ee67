"""Language-model scores by a weighted backoff automaton of word n-grams.

The model.  With c the counts in training texts and P0(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

    P(w | h) = (c(h w) + K P(w | h')) / (c(h) + K),    h' = h without its first word,

a hierarchical Dirichlet smoothing that sums to one for every context h, whatever K is there.
K = ``STRENGTH`` c(h) ** ``GROWTH`` follows the kinds of words that a context is expected to
have, which grow as a power of its uses.  As an automaton: a context seen in training is a
state, a counted n-gram an arc with weight log P(w | h) to the state of its longest suffix
that is one, and log K / (c(h) + K) the weight of the failure arc to the state of h'.  A text
is read once from left to right; each token follows failure arcs from its state until an arc
matches, adds the logarithms, and moves on.

The automaton of a whole corpus fits nowhere, so it is cut by use:

1. Documents belong to blocks of about ``BLOCK_BYTES`` of text.  Tasks count the n-grams of
   each block they meet and send them, sorted, to buckets by hash: (bucket, block, keys, counts).
2. A bucket sums the training counts of its n-grams over all blocks and answers each block
   with the totals, in the order of the block's sorted keys.
3. A block gets its documents, compressed, and its answers: exactly the states and arcs that
   its texts can touch, whatever the size of the corpus.  There the automaton is built and the
   texts are read, all in step; a long text is read in stretches, each from the state that the
   words before it lead to, which depends on ``ORDER`` - 1 words only.

All of the corpus is counted, with no cut-off, so what is gathered grows with the input.  A
common word costs one entry a block, never a row for each of its uses.  Keys of single words
have 64 bits; those of longer n-grams have ``SPARE`` bits more than their number needs, so one
takes another's count with a chance of about 2**-SPARE at every size of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import checkpointed, left_join_unique

ORDER = 3
STRENGTH, GROWTH = 2.0, 0.9
BLOCK_BYTES = 5 << 20
BUCKET_BYTES = 6 << 20
FLUSH_KEYS = 2_500_000
SPARE = 22
STRETCH = 512
#: Runs of ids that are broadcast at most.
SMALL = 65_536

END = np.uint64(0x6A09E667F3BCC909)
START = np.uint64(0xBB67AE8584CAA73B)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and one end for each row, and the offsets of the rows."""
    parts, counts = [], []
    for lo, hi, hashes, offsets in W.word_hashes(column):
        n = np.diff(offsets)
        out = np.empty(len(hashes) + hi - lo, dtype=np.uint64)
        row = np.repeat(np.arange(hi - lo), n)
        out[np.arange(len(hashes)) + row] = hashes
        out[np.cumsum(n + 1) - 1] = END
        parts.append(out)
        counts.append(n + 1)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)


def _grams(tokens: np.ndarray, offsets: np.ndarray, order: int, bits: int = 64) -> list[np.ndarray]:
    """For n = 1 to ``order``: the key of the n-gram that ends at each token; before a text stand starts.

    Keys of single tokens have 64 bits, all others the first ``bits`` of them.
    """
    first = np.repeat(offsets[:-1], np.diff(offsets))
    at = np.arange(len(tokens))
    out = [tokens]
    gram = tokens
    for n in range(2, order + 1):
        back = at - (n - 1)
        word = np.where(back >= first, tokens[np.maximum(back, 0)], START)
        gram = W.mix(gram * _STEP + word + np.uint64(n))
        out.append(gram >> np.uint64(64 - bits))
    return out


def _planes(values: np.ndarray, raw: int) -> bytes:
    """Numbers byte plane by byte plane: the ``raw`` low ones as they are, the skewed high ones compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return planes[:raw].tobytes() + zlib.compress(planes[raw:].tobytes(), 1)


def _unplaned(data: bytes, n: int, raw: int) -> np.ndarray:
    planes = data[: raw * n] + zlib.decompress(data[raw * n :])
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, n).T).view(np.uint64).ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as steps; the low four bytes of a step are as good as random."""
    return len(keys).to_bytes(8, "little") + _planes(np.diff(keys, prepend=np.uint64(0)), 4)


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(data[8:], int.from_bytes(data[:8], "little"), 4), dtype=np.uint64)


def _bucket(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Buckets follow the order of the keys."""
    return (((keys << np.uint64(64 - bits)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _distinct(grams: list[np.ndarray], train: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For single words and for all longer n-grams: sorted distinct keys, and their training counts or each one's number."""
    out = []
    for part in (grams[:1], grams[1:]):
        keys, inverse = np.unique(np.concatenate(part), return_inverse=True) if part else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        out.append((keys, inverse if train is None else np.bincount(inverse, np.tile(train, len(part)), minlength=len(keys)).astype(np.int64)))
    return out


def _count(order: int, buckets: int, bits: int):
    """(block, train, text) to (bucket, block, words, grams, counts): training counts of all n-grams, 0 included."""
    names = ["bucket", "block", "words", "grams", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                grams = [np.concatenate([p[0][k] for p in parts]) for k in range(order)]
                (words, n_words), (longer, n_longer) = _distinct(grams, np.concatenate([p[1] for p in parts]))
                at, at_longer = (np.searchsorted(_bucket(x, buckets, b), np.arange(buckets + 1).astype(np.uint64)) for x, b in ((words, 64), (longer, bits)))
                rows = [b for b in range(buckets) if at[b + 1] > at[b] or at_longer[b + 1] > at_longer[b]]
                own = lambda x, where, b: x[where[b] : where[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, pa.int64()),
                        pa.array([block] * len(rows), pa.int64()),
                        pa.array([_packed(own(words, at, b)) for b in rows], pa.binary()),
                        pa.array([_packed(own(longer, at_longer, b)) for b in rows], pa.binary()),
                        pa.array([_planes(np.concatenate([own(n_words, at, b), own(n_longer, at_longer, b)]), 0) for b in rows], pa.binary()),
                    ],
                    names,
                )
            held.clear()

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            trains = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo in range(0, batch.num_rows, 256):
                tokens, offsets = _tokens(batch.column(2).slice(lo, 256))
                grams = _grams(tokens, offsets, order, bits)
                n = np.diff(offsets)
                block, train = np.repeat(blocks[lo : lo + 256], n), np.repeat(trains[lo : lo + 256], n)
                for b in np.unique(blocks[lo : lo + 256]):
                    own = block == b
                    held.setdefault(int(b), []).append(([g[own] for g in grams], train[own]))
                size += len(tokens) * order
                if size > FLUSH_KEYS:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """One bucket: for each block its keys' training totals; block -1 has the bucket's training tokens and distinct words."""
    order = np.argsort(table.column("block").to_numpy(), kind="stable")
    block = table.column("block").to_numpy()[order]
    sent = [table.column("counts")[int(k)].as_py() for k in order]
    every_key = [sum(int.from_bytes(table.column(c)[int(k)].as_py()[:8], "little") for c in ("words", "grams")) for k in order]
    counts = [_unplaned(x, n, 0).view(np.int64) for x, n in zip(sent, every_key, strict=True)]
    parts, tokens, distinct = [], 0, 0
    sizes = None
    for name in ("words", "grams"):
        keys = [_unpacked(table.column(name)[int(k)].as_py()) for k in order]
        n = np.array([len(k) for k in keys])
        own = [c[: len(k)] if sizes is None else c[m:] for c, k, m in zip(counts, keys, n if sizes is None else sizes, strict=True)]
        sizes = n if sizes is None else sizes
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        totals = np.bincount(inverse, np.concatenate(own), minlength=len(every)).astype(np.int64)
        if name == "words":
            tokens, distinct = int(totals.sum()), int((totals > 0).sum())
        ends = np.cumsum(n)
        found = {}
        for b in np.unique(block):
            which = np.flatnonzero(block == b)
            places = np.concatenate([inverse[ends[w] - n[w] : ends[w]] for w in which])
            found[int(b)] = totals[np.unique(places) if len(which) > 1 else places]
        parts.append(found)
    named = list(parts[0])
    answers = []
    for b in named:
        both = np.concatenate([parts[0][b], parts[1][b]])
        answers.append(len(both).to_bytes(8, "little") + _planes(both, 0))
    named.append(-1)
    answers.append(np.array([tokens, distinct], dtype=np.int64).tobytes())
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"block": pa.array(named, pa.int64()), "bucket": pa.array([bucket] * len(named), pa.int64()), "answer": pa.array(answers, pa.binary())})


def _unanswered(data: bytes) -> np.ndarray:
    return _unplaned(data[8:], int.from_bytes(data[:8], "little"), 0).view(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([np.frombuffer(x, dtype=np.int64) for x in batch.column(0).to_pylist()], dtype=np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(values[:, 0]), pa.array(values[:, 1])], ["tokens", "words"])


@dataclass
class Automaton:
    """States and arcs as arrays by number.  An n-gram's number is its arc's; as a context it is a state of that number.

    Behind the n-grams come the states of 1 to order - 1 starts, and last the root.
    """

    counts: np.ndarray
    length: np.ndarray  # words of the n-gram or state
    weight: np.ndarray  # log10 probability of the arc
    target: np.ndarray  # state behind the arc
    failure: np.ndarray  # state behind the failure arc
    backoff: np.ndarray  # log10 weight of the failure arc
    root: int
    start: int

    def read(self, grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The log10 probability of each token; ``grams`` has the number of the n-gram that ends there, for each n.

        All texts are read in step, long ones in stretches of STRETCH tokens.
        """
        order = len(grams)
        out = np.zeros(grams.shape[1])
        n = np.diff(offsets)
        pieces = -(-n // STRETCH)
        row = np.repeat(np.arange(len(n)), pieces)
        lo = offsets[row] + STRETCH * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        hi = np.minimum(lo + STRETCH, offsets[row + 1])
        # the words before a stretch lead from the root to its first state
        begin = np.maximum(lo - (order - 1), offsets[row])
        state = np.where(begin == offsets[row], self.start, self.root)
        by = np.argsort(begin - hi, kind="stable")
        lo, hi, begin, state = lo[by], hi[by], begin[by], state[by]
        left = hi - begin
        for turn in range(int(left.max(initial=0))):
            alive = int(np.searchsorted(-left, -turn))
            at, now = begin[:alive] + turn, state[:alive]
            gram = grams[self.length[now], at]
            step = np.zeros(alive)
            stuck = np.flatnonzero((self.counts[gram] == 0) & (now != self.root))
            while len(stuck):
                step[stuck] += self.backoff[now[stuck]]
                now[stuck] = self.failure[now[stuck]]
                gram[stuck] = grams[self.length[now[stuck]], at[stuck]]
                stuck = stuck[(self.counts[gram[stuck]] == 0) & (now[stuck] != self.root)]
            step += self.weight[gram]
            state[:alive] = self.target[gram]
            own = at >= lo[:alive]
            out[at[own]] = step[own]
        return out


def automaton(grams: np.ndarray, offsets: np.ndarray, counts: np.ndarray, base: np.ndarray, starts: int, strength: float, growth: float) -> Automaton:
    """The automaton of the n-grams that texts touch.

    ``grams`` (order, tokens) numbers the n-gram that ends at each token, ``counts`` are their
    training counts, ``base`` the probabilities of single words by number, ``starts`` the
    training texts.
    """
    order, size = len(grams), len(counts)
    start, root = size + order - 2, size + order - 1
    begins = np.zeros(grams.shape[1], dtype=bool)
    begins[offsets[:-1]] = True
    length = np.zeros(root + 1, dtype=np.int8)
    context, failure = np.full(root + 1, root, dtype=np.int32), np.full(root + 1, root, dtype=np.int32)
    for k in range(order):
        length[grams[k]] = k + 1
        if k:
            failure[grams[k]] = grams[k - 1]
            context[grams[k]] = np.where(begins, size + k - 1, np.concatenate([[root], grams[k - 1][:-1]]))
            length[size + k - 1] = k
            failure[size + k - 1] = size + k - 2 if k > 1 else root
    every = np.append(counts, np.full(order, starts))
    own = strength * np.maximum(every, 1).astype(np.float64) ** growth
    backoff = np.log10(own / (every + own))
    backoff[root] = 0.0
    value = np.zeros(root + 1)
    value[: len(base)] = base
    for k in range(1, order):
        g = np.flatnonzero(length[:size] == k + 1)
        h = context[g]
        value[g] = (every[g] + own[h] * value[failure[g]]) / (every[h] + own[h])
    number = np.arange(root + 1, dtype=np.int32)
    target = np.where(length == order, failure, np.where(every > 0, number, np.int32(root)))
    return Automaton(every, length, np.log10(np.maximum(value, 1e-300)), target, failure, backoff, root, start if order > 1 else root)


_DOCS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.large_string())])


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, doc_id, held_out, text) to (block, docs): the documents of a block together, compressed."""
    held: dict[int, list[pa.RecordBatch]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for block, parts in held.items():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _DOCS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_table(pa.Table.from_batches(parts).combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])
        held.clear()

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        rows = pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3).cast(pa.large_string())], schema=_DOCS)
        for b in np.unique(blocks):
            held.setdefault(int(b), []).append(rows.take(pa.array(np.flatnonzero(blocks == b))))
        size += batch.nbytes
        if size > BLOCK_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def _traverse(order: int, bits: int, buckets: int, strength: float, growth: float, train_tokens: int, distinct: int, starts: int):
    total = train_tokens + 0.1 * (distinct + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        rows = pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in docs.column("docs")])
        tokens, offsets = _tokens(rows.column("text").combine_chunks())
        grams = _grams(tokens, offsets, order, bits)
        del tokens
        (words, number), (longer, number_longer) = _distinct(grams)
        numbers = np.concatenate([number.astype(np.int32), (number_longer + len(words)).astype(np.int32)]).reshape(order, -1)
        del grams, number, number_longer
        # a bucket answers for its words and then for its longer n-grams
        counts = np.zeros(len(words) + len(longer), dtype=np.int64)
        at, at_longer = (np.searchsorted(_bucket(x, buckets, b), np.arange(buckets + 1).astype(np.uint64)) for x, b in ((words, 64), (longer, bits)))
        met = 0
        for bucket, answer in zip(answers.column("bucket").to_numpy(), answers.column("answer"), strict=True):
            own = _unanswered(answer.as_py())
            k = int(at[bucket + 1] - at[bucket])
            counts[at[bucket] : at[bucket + 1]] = own[:k]
            counts[len(words) + at_longer[bucket] : len(words) + at_longer[bucket + 1]] = own[k:]
            met += len(own)
        if met != len(counts):
            raise ValueError(f"{met} answers for {len(counts)} n-grams")
        base = (counts[: len(words)] + 0.1) / total
        step = automaton(numbers, offsets, counts, base, starts, strength, growth).read(numbers, offsets)
        single = numbers[0]
        sums = lambda x: np.add.reduceat(x, offsets[:-1])
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "held_out": rows.column("held_out"),
                "n_tokens": pa.array(np.diff(offsets)),
                "n_known": pa.array(sums((counts[single] > 0).astype(np.int64))),
                "base_score": pa.array(sums(np.log10(base)[single])),
                "score": pa.array(sums(step)),
            }
        )

    return run


def score(docs: DataFrame, held_out: Column, order: int = ORDER, strength: float = STRENGTH, growth: float = GROWTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    The model learns from the rows where ``held_out`` is not true.  A null text is empty: one
    token, the end.  Repeated rows count again.  Without training rows all counts are 0 and
    every token has probability 1.  An empty table gives an empty result.  Rows that share an
    id, or have none, are dealt by their texts; only rows equal in both share a block for sure.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count("*").alias("rows"), F.count_if(~F.col("held_out")).alias("train")).first()
    blocks, buckets = (max(1, -(-size["bytes"] // n)) for n in (BLOCK_BYTES, BUCKET_BYTES))
    bits = min(64, max(32, int(size["bytes"] * order // 6 + 1).bit_length() + SPARE))
    # ids that are near each other share a block, so tasks count long runs of a block; a run that
    # is too long, as of a repeated id, is dealt by texts, and so are rows without an id
    near = max(64, size["rows"] // blocks // 3)
    rows = rows.withColumn("run", F.floor(F.col("doc_id") / near))
    long = rows.groupBy("run").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).where(F.col("run").isNotNull() & (F.col("bytes") > 2 * BLOCK_BYTES))
    long = checkpointed(long.select(F.col("run").alias("long"), "n", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("parts")))
    if long.count() <= SMALL:
        rows = rows.join(F.broadcast(long.drop("n")), F.col("run") == F.col("long"), "left").drop("long")
    else:
        rows = left_join_unique(rows, long.withColumnRenamed("long", "run"), "run", "n", size["rows"])
    part = F.when(F.col("run").isNull(), F.xxhash64("text")).when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("text"), "parts")).otherwise(F.lit(0))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("run", part), F.lit(blocks)))
    sent = rows.select("block", (~F.col("held_out")).alias("train"), "text").mapInArrow(_count(order, buckets, bits), "bucket long, block long, words binary, grams binary, counts binary")
    answers = sent.groupBy("bucket").applyInArrow(_answer, "block long, bucket long, answer binary")
    answers = checkpointed(answers)
    sums = answers.where("block = -1").select("answer").mapInArrow(_sums, "tokens long, words long").agg(F.sum("tokens"), F.sum("words")).first()
    tokens, distinct = (x or 0 for x in sums)
    fit = _traverse(order, bits, buckets, strength, growth, tokens, distinct, size["train"])
    bundles = rows.select("block", "doc_id", "held_out", "text").mapInArrow(_bundles, "block long, docs binary")
    out = bundles.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(fit, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))
