"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every text becomes its set of distinct word shingles, in Arrow batches: an id of the
   whole set, ``COORDS`` MinHash coordinates and a parity bitmap.  Texts with one set
   collapse into one node, however many copies there are.
2. Nodes are posted under coordinate-value keys.  One posting joins ``JOINED`` neighbouring
   coordinates, the prefix of the merge: texts at the threshold share at least one of the
   keys but for a chance of about (1 - s**3)**16 = 1e-5.
3. Inside a posting list collisions are counted over all coordinates.  Pairs below
   ``MATCHES`` are skipped; at the threshold a pair falls below it with a chance of 3e-6.
   A parity bitmap then bounds the symmetric difference of the two sets from below, so
   pairs that can't reach the threshold go without a look at their sets.
4. What is left is confirmed on the full sets.  A list needs no all-pairs output for that:
   one round emits the best pairs that would join different texts (a spanning forest, at
   most one pair per node and list); another emits every remaining pair between different
   components, so no link between components is lost.
   Lists longer than ``BLOCK`` are cut into blocks.  In the last round the texts of a list's
   largest component and those outside are dealt into groups; a cell of the grid of groups
   holds two of them, and a pair of texts is compared in the one cell that owns it.

Sets are held as 64-bit hashes of shingles and named by 128 bits of them; shingles are not
compared letter by letter, so two unlike ones are taken for one with a chance of 2**-64.
Labels of large components and texts of many copies are hot keys and join by
``left_join_unique``; the sets of hubs join by numbered copies of the set.  Keys of long lists
join with written tables of one row a key, so adaptive execution can split their side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components, merged
from .shared import checkpointed, fields, left_join_unique, narrowed, whole

COORDS, JOINED = 48, 3
MATCHES = 25
PARITY_BITS = 1024
#: Texts of a block of a list, and of a group in the cells of the last round.
BLOCK, GROUP = 512, 384
#: Pairs that one copy of a set answers.
PAIRS = 256

_rng = np.random.default_rng(4242)
_XOR = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, COORDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, COORDS) MinHash coordinates; every row must hold a shingle."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, COORDS), dtype=np.uint32)
    for i in range(COORDS):
        v = (low ^ _XOR[i]) * _MUL[i]
        v ^= v >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), offsets[:-1])
    return out


def posting_keys(signature: np.ndarray) -> np.ndarray:
    """(rows, COORDS / JOINED) keys of coordinate number and values."""
    parts = signature.reshape(len(signature), -1, JOINED).astype(np.uint64)
    h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2])
    for j in range(JOINED):
        h = W.mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return h.view(np.int64)


def parity(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, PARITY_BITS / 64) bitmaps: a bit is the parity of the shingles that fall on it."""
    out = np.zeros((len(sets), PARITY_BITS), dtype=np.uint8)
    for row, s in enumerate(sets):
        out[row] = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def _set_id(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketch(size: int):
    names = ["doc_id", "text_key", "n_shingles", "set_id", "keys", "signature", "parity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text, text_key = batch.column(0), batch.column(1), batch.column(2)
            for lo, hi, words, offsets in W.word_hashes(text):
                hashes, at = W.shingles(words, offsets, size)
                sets = [np.unique(hashes[at[k] : at[k + 1]]) for k in range(hi - lo)]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(n)
                blank = [None] * (hi - lo)
                columns = {"set_id": list(blank), "keys": list(blank), "signature": list(blank), "parity": list(blank)}
                if len(full):
                    kept = [sets[k] for k in full]
                    signature = signatures(np.concatenate(kept), np.concatenate([[0], np.cumsum(n[full])]))
                    keys, bits = posting_keys(signature), parity(kept)
                    for i, k in enumerate(full):
                        columns["set_id"][k] = _set_id(kept[i])
                        columns["keys"][k] = keys[i]
                        columns["signature"][k] = signature[i].tobytes()
                        columns["parity"][k] = bits[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        text_key.slice(lo, hi - lo),
                        pa.array(n),
                        pa.array(columns["set_id"], pa.binary()),
                        pa.array(columns["keys"], pa.list_(pa.int64())),
                        pa.array(columns["signature"], pa.binary()),
                        pa.array(columns["parity"], pa.binary()),
                    ],
                    names,
                )

    return run


def _pairs(percent: int, forest: bool):
    """Candidate pairs of each posting list; rows come sorted by (key, block).

    Texts of one side are compared with those of the other; where all have side 0, with each other.
    """

    def of(table: pa.Table) -> pa.RecordBatch:
        key = np.stack([table.column("key").to_numpy(), table.column("block").to_numpy()])
        node = table.column("node").to_pylist()
        label = np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
        n, side = table.column("n").to_numpy(), table.column("side").to_numpy()
        signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint32).reshape(-1, COORDS)
        bits = np.frombuffer(b"".join(table.column("parity").to_pylist()), dtype=np.uint64).reshape(-1, PARITY_BITS // 64)
        left, right, rank = [], [], []
        alive = np.arange(len(n))
        step = 0
        while len(alive):
            step += 1
            alive = alive[alive + step < len(n)]
            i, j = alive, alive + step
            same = (key[0][i] == key[0][j]) & (key[1][i] == key[1][j])
            alive = i[same]
            i, j = alive, alive + step
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (label[i] != label[j]) & ((side[i] != side[j]) | (side[i] == 0)) & (100 * small >= percent * large)
            i, j = i[ok], j[ok]
            for lo in range(0, len(i), 20000):
                a, b = i[lo : lo + 20000], j[lo : lo + 20000]
                hits = (signature[a] == signature[b]).sum(axis=1)
                a, b, hits = a[hits >= MATCHES], b[hits >= MATCHES], hits[hits >= MATCHES]
                apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
                ok = apart * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
                left.append(a[ok]), right.append(b[ok]), rank.append(apart[ok] / np.maximum(1, n[a] + n[b])[ok] - hits[ok] / COORDS)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        if forest and len(a):
            order = np.argsort(np.concatenate(rank), kind="stable")
            chosen, root = [], np.arange(int(label.max()) + 1)

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            la, lb = label[a], label[b]
            for k in order:
                p, q = find(la[k]), find(lb[k])
                if p != q:
                    root[p] = q
                    chosen.append(k)
            a, b = a[chosen], b[chosen]
        return pa.RecordBatch.from_arrays([pa.array([node[x] for x in y], pa.binary()) for y in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 4096:
                continue
            table = pa.Table.from_batches(held)
            key, block = table.column("key").to_numpy(), table.column("block").to_numpy()
            cut = np.flatnonzero((key != key[-1]) | (block != block[-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield of(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), len(table) - cut
        if held:
            yield of(pa.Table.from_batches(held))

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for lo, hi, words, offsets in W.word_hashes(batch.column(1)):
                hashes, at = W.shingles(words, offsets, size)
                sets = [np.unique(hashes[at[k] : at[k + 1]]) for k in range(hi - lo)]
                own = [k for k in range(hi - lo) if _set_id(sets[k]) == wanted[lo + k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([wanted[lo + k] for k in own], pa.binary()), pa.array([sets[k].view(np.int64) for k in own], pa.list_(pa.int64()))],
                    ["node", "shingles"],
                )

    return run


def _full_sets(pairs: DataFrame, nodes: DataFrame, base: DataFrame, known: DataFrame | None, size: int) -> DataFrame | None:
    """(node, shingles) of the nodes of ``pairs`` that ``known`` lacks, each from one text of the node."""
    missing = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if known is not None:
        missing = missing.join(known.select("node"), "node", "left_anti")
    if known is not None and not missing.limit(1).count():
        return known
    wanted = missing.join(nodes.select("node", "first"), "node").select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    texts = base.join(wanted, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    found = texts.select("node", "text").mapInArrow(_sets(size), "node binary, shingles array<bigint>").dropDuplicates(["node"])
    found = checkpointed(found)
    return found if known is None else known.union(found)


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str, name: str) -> DataFrame:
    """``pairs`` with the set of the node in the column ``end``.

    A hub's set comes in numbered copies, one for about PAIRS of its pairs, so none is a hot key.
    """
    degrees = pairs.groupBy(end).agg(F.count("*").alias("_degree"))
    own = sets.select(F.col("node").alias(end), F.col("shingles").alias(name))
    if (degrees.agg(F.max("_degree")).first()[0] or 0) <= PAIRS:
        return pairs.join(own, end)
    copies = degrees.select(end, "_degree", F.ceil(F.col("_degree") / PAIRS).alias("_copies"))
    other = "b" if end == "a" else "a"
    dealt = left_join_unique(pairs, copies, end, "_degree", pairs.count()).withColumn("_copy", F.pmod(F.xxhash64(other), F.col("_copies")))
    own = own.join(copies, end).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))).select(end, "_copy", name)
    return dealt.join(own, [end, "_copy"]).drop("_degree", "_copies", "_copy")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, linked) decided on full sets."""
    both = _with_sets(_with_sets(pairs, sets, "a", "sa"), sets, "b", "sb").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    union = F.size("sa") + F.size("sb") - F.col("common")
    return both.select("a", "b", (100 * F.col("common") >= percent * union).alias("linked"))


def _cells(at: DataFrame) -> DataFrame:
    """Rows of long lists in the cells of their list: block is the cell, side tells its two groups apart.

    Texts outside the main component are cut into groups of about GROUP, and so are those in it.
    A cell holds two groups: two of those outside, or one outside and one of the main
    component.  Pairs inside a group outside meet in that group's own cell, of side 0 only.
    A list of at most BLOCK texts is one cell, of side 0.
    """
    groups = lambda n: F.greatest(F.lit(1), F.ceil(n / GROUP))
    out_groups, main_groups = groups(F.col("outside")), groups(F.col("rows") - F.col("outside"))
    out = F.col("out") == 1
    group = F.pmod(F.xxhash64("node", "key"), F.when(out, out_groups).otherwise(main_groups))
    cell = lambda kind, a, b, side: F.struct((F.lit(kind << 60) + F.shiftleft(a, 30) + b).alias("block"), side.cast("long").alias("side"))
    one, two = F.lit(1), F.lit(2)
    among = F.transform(F.sequence(F.lit(0).cast("long"), out_groups - 1), lambda g: cell(1, F.least(F.col("_group"), g), F.greatest(F.col("_group"), g), F.when(g == F.col("_group"), 0).when(g < F.col("_group"), 1).otherwise(2)))
    toward = F.transform(F.sequence(F.lit(0).cast("long"), main_groups - 1), lambda g: cell(2, F.col("_group"), g, one))
    against = F.transform(F.sequence(F.lit(0).cast("long"), out_groups - 1), lambda g: cell(2, g, F.col("_group"), two))
    small = F.array(F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("side")))
    cells = F.when(F.col("rows") <= BLOCK, small).when(out, F.concat(among, toward)).otherwise(against)
    at = at.withColumn("_group", group).withColumn("_cell", F.explode(cells))
    return at.withColumn("block", F.col("_cell.block")).withColumn("side", F.col("_cell.side"))


def _classes(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, int, DataFrame]:
    """The sketched rows, their number, and (node, members, label, component_id, representative) of each set of shingles.

    A representative is the (doc_id, text_key) of the smallest id, null last, then the smallest key of its component.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    schema = "doc_id long, text_key long, n_shingles long, set_id binary, keys array<bigint>, signature binary, parity binary"
    sketches = checkpointed(base.mapInArrow(_sketch(size), schema))
    total = sketches.count()
    sized = sketches.where("set_id is not null")
    nodes = checkpointed(
        sized.groupBy(F.col("set_id").alias("node")).agg(
            F.min("doc_id").alias("first_id"), F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"), F.count("*").alias("members"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("signature").alias("signature"), F.first("parity").alias("parity")
        )
    )
    kinds = nodes.count()
    posts = nodes.select("node", F.explode("keys").alias("key"))
    lists = checkpointed(posts.groupBy("key").agg(F.count("*").alias("length")).where("length > 1"))
    posts = checkpointed(posts.join(lists, "key").join(nodes.select("node", "n", "signature", "parity"), "node"))
    shared = posts.count()
    posts = narrowed(posts, shared, 5_000)

    def listed(at: DataFrame, forest: bool) -> DataFrame:
        rows = at.select("key", "block", "side", "node", "label", "n", "signature", "parity").repartition("key", "block").sortWithinPartitions("key", "block", "node")
        found = rows.mapInArrow(_pairs(percent, forest), "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return found.distinct()

    zero = F.lit(0).cast("long")
    own = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("length") / BLOCK))
    pairs = checkpointed(narrowed(listed(posts.withColumn("label", F.col("node")).withColumn("side", zero).withColumn("block", own), True), shared))
    sets = _full_sets(pairs, nodes, base, None, size)
    decided = checkpointed(_confirmed(pairs, sets, percent))
    edges = decided.where("linked").select("a", "b")
    labels = components(edges)
    # what is left: every pair between different components that meet in a list
    weights = labels.groupBy("label").agg(F.count("*").alias("weight"))
    labelled = left_join_unique(labels, weights, "label", "weight", kinds)
    at = posts.join(labelled, "node", "left")
    at = at.withColumn("label", F.coalesce("label", "node")).withColumn("weight", F.coalesce("weight", F.lit(1)))
    own_rows = at.groupBy("key", "label").agg(F.count("*").alias("own"), F.max("weight").alias("weight"))
    rank = F.struct("weight", "label")
    mains = own_rows.groupBy("key").agg(F.sum("own").alias("rows"), F.max_by("label", rank).alias("main"), (F.sum("own") - F.max_by("own", rank)).alias("outside"))
    at = at.join(checkpointed(mains.where("outside > 0")), "key")
    at = at.withColumn("out", (F.col("label") != F.col("main")).cast("long"))
    at = _cells(at)
    pairs = checkpointed(narrowed(listed(at, False).join(decided.select("a", "b"), ["a", "b"], "left_anti"), shared))
    sets = _full_sets(pairs, nodes, base, sets, size)
    late = checkpointed(_confirmed(pairs, sets, percent).where("linked").select("a", "b"))
    if late.limit(1).count():
        labels = merged(labels, late, kinds)
    classes = nodes.select("node", "first_id", "first", "members").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("first.doc_id").isNull(), "first.doc_id", "first.text_key")
    smallest = classes.groupBy("label").agg(F.min("first_id").alias("component_id"), F.min_by("first", order).alias("representative"), F.count("*").alias("kinds"))
    classes = left_join_unique(classes, smallest, "label", "kinds", kinds)
    return sketches, total, classes.select("node", "members", "label", "component_id", "representative")


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id, kept).

    Documents whose sets of distinct ``size``-word shingles (ASCII lower case) have a Jaccard
    similarity of at least ``percent`` / 100 are linked; component_id is the smallest id
    reachable, and kept marks it.  A text of fewer words is one shingle; a null or wordless
    text has no shingle, is linked with nothing and stays.  Rows with equal ids are rows of
    their own and are linked by their texts; a row whose id is null takes part but is
    never kept.  An empty table gives an empty result.
    """
    sketches, total, classes = _classes(docs, size, percent, id_col, text_col)
    classes = classes.select(F.col("node").alias("set_id"), "component_id", "members")
    rows = sketches.select("doc_id", "n_shingles", "set_id")
    out = left_join_unique(rows, classes, "set_id", "members", total)
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each component of ``near_duplicates``, and every row without a shingle.

    The row is that of the smallest id, null last, and among equal ids the one of the smallest
    hash of its text; of rows that agree in both, the smallest by all columns.  So rows
    without an id and rows that share an id are kept or dropped by their texts alone.
    """
    sketches, total, classes = _classes(docs, size, percent, id_col, text_col)
    key = lambda i, k: F.struct(i.isNull().alias("none"), F.coalesce(i, F.lit(0)).alias("id"), k.alias("key"))
    per_key = sketches.select(key(F.col("doc_id"), F.col("text_key")).alias("_own"), F.col("set_id").isNull().alias("_bare")).groupBy("_own", "_bare").agg(F.count("*").alias("_n"))
    chosen = classes.select(key(F.col("representative.doc_id"), F.col("representative.text_key")).alias("_own")).distinct()
    wanted = checkpointed(per_key.where("_bare").unionByName(per_key.where("not _bare").join(chosen, "_own", "left_semi")))
    keyed = docs.select(whole(docs), key(F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`"))).alias("_own"))
    found = left_join_unique(keyed, wanted, "_own", "_n", total).where("_n is not null")
    several = ~F.col("_bare") & (F.col("_n") > 1)
    out = found.where(~several).select("doc")
    if wanted.where(several).limit(1).count():
        out = out.union(found.where(several).groupBy("_own").agg(F.min("doc").alias("doc")).select("doc"))
    return out.select(*fields(docs))
