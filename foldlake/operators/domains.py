"""Splitting chains into domains by recursive bisection of their contact graphs.

Graphs are edge tables made by Spark: plain contacts, contacts averaged over perturbed copies, or
contacts weighed by what a network says of their ends.  One chain's edges meet in one task as
lists of edges, so memory follows the contacts and never the square of the chain.  The perturbed
runs of a consensus are rows of their own and spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..plans.lineage import cut
from . import geometry as G

MAX_CUT, LEAST, SHORT, MOST = 0.08, 40, 50, 8
#: Chains of this length are held to the ceiling as it stands; see ``scale``.
CEILING_LENGTH = 250
#: How far the contact distance moves between perturbed runs, and the noise of their coordinates.
CUT_SHIFT, NOISE = 0.4, 0.4
#: Points of a graph whose spectrum is taken from the whole matrix, which is 2 MB at most.
WHOLE = 512
#: Residues whose edges are weighed by one task.
VECTOR_BLOCK = 2048
#: Seed of run k: (first, step); one pair for each use of perturbed copies.
RUN_SEEDS = {"vote": (0x9E37, 7919), "graph": (0x51ED, 2654435761), "score": (0x7A19, 40503)}


@dataclass
class Graph:
    """n points and their edges i, j of weight w, each both ways, in the order of i."""

    n: int
    i: np.ndarray
    j: np.ndarray
    w: np.ndarray

    @classmethod
    def of(cls, n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> Graph:
        order = np.argsort(i, kind="stable")
        return cls(n, np.asarray(i)[order].astype(np.int64), np.asarray(j)[order].astype(np.int64), np.asarray(w, dtype=float)[order])

    @classmethod
    def dense(cls, table: np.ndarray) -> Graph:
        i, j = np.nonzero(table)
        return cls(len(table), i, j, table[i, j])

    def part(self, nodes: np.ndarray) -> Graph:
        """The graph of some nodes, numbered in their order, without edges to others."""
        place = np.full(self.n, -1)
        place[nodes] = np.arange(len(nodes))
        own = (place[self.i] >= 0) & (place[self.j] >= 0)
        return Graph.of(len(nodes), place[self.i[own]], place[self.j[own]], self.w[own])

    def degree(self) -> np.ndarray:
        return np.bincount(self.i, self.w, minlength=self.n)

    def of_rows(self, lo: int, hi: int) -> slice:
        """The edges of the nodes lo to hi - 1."""
        return slice(*np.searchsorted(self.i, [lo, hi]))


def _sweep(g: Graph, order: np.ndarray, least: int) -> tuple[float, int] | None:
    """The first smallest normalised cut over prefixes of ``order``, both sides of ``least`` at least."""
    place = np.empty(g.n, dtype=np.int64)
    place[order] = np.arange(g.n)
    a = np.cumsum(g.degree()[order])
    inner = np.cumsum(np.bincount(np.maximum(place[g.i], place[g.j]), g.w, minlength=g.n))
    cut, b = a - inner, a[-1] - a
    k = np.arange(least - 1, g.n - least)
    k = k[(a[k] > 1e-12) & (b[k] > 1e-12)]
    if not len(k):
        return None
    score = cut[k] / a[k] + cut[k] / b[k]
    at = int(np.argmin(score))
    return float(score[at]), int(k[at]) + 1


def leading(apply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, known: np.ndarray, steps: int = 60, restarts: int = 200, exact: float = 1e-11) -> tuple[float, np.ndarray]:
    """The largest eigenvalue of a symmetric map, and its vector, apart from the ``known`` ones (rows).

    Powers of the map on the start are made orthogonal to each other and to what is known; the
    best mixture of them is the next start, until it is an eigenvector.
    """
    clean = lambda v, rows: v - rows.T @ (rows @ v)
    x = clean(clean(start, known), known)
    x /= np.linalg.norm(x)
    value = 0.0
    for _ in range(restarts):
        basis, images, last = [x], [], 0.0
        for _ in range(min(steps, len(x) - len(known))):
            y = apply(basis[-1])
            images.append(y)
            rows = np.concatenate([known, basis])
            y = clean(clean(y, rows), rows)
            last = float(np.linalg.norm(y))
            if last < 1e-13:
                break
            basis.append(y / last)
        rows = np.array(basis[: len(images)])
        values, mixtures = np.linalg.eigh(rows @ np.array(images).T)
        value, x = float(values[-1]), mixtures[:, -1] @ rows
        x /= np.linalg.norm(x)
        if last < 1e-13 or abs(last * mixtures[-1, -1]) < exact:
            break
    return value, x if x @ start >= 0 else -x


def _spread(g: Graph) -> tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]:
    """The normalised adjacency, moved into 0..1, and its first vector, which is known."""
    degree = g.degree()
    scale = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1e-300)), 0)
    weight = g.w * scale[g.i] * scale[g.j]
    return lambda x: (np.bincount(g.i, weight * x[g.j], minlength=g.n) + x) / 2, np.sqrt(degree / degree.sum())


def _start(n: int, k: int = 0) -> np.ndarray:
    """A fixed vector without symmetry."""
    return np.sin((np.arange(n) + 1) * (0.7391 + 0.131 * k)) + 0.1


def second_vector(g: Graph) -> np.ndarray:
    """The vector of the second smallest eigenvalue of the normalised Laplacian."""
    apply, first = _spread(g)
    return leading(apply, _start(g.n), first[None])[1]


def spectrum(g: Graph, most: int) -> np.ndarray:
    """The ``most`` smallest eigenvalues of the normalised Laplacian after the first, which is 0."""
    if not len(g.w) or g.n < 2:
        return np.zeros(0)
    if g.n <= WHOLE:
        degree = g.degree()
        scale = np.where(degree > 0, 1 / np.sqrt(np.maximum(degree, 1e-300)), 0)
        whole = np.zeros((g.n, g.n))
        np.add.at(whole, (g.i, g.j), g.w * scale[g.i] * scale[g.j])
        return 1 - np.linalg.eigvalsh(whole)[::-1][1 : most + 1]
    apply, first = _spread(g)
    known, out = first[None], []
    for k in range(min(most, g.n - 1)):
        value, vector = leading(apply, _start(g.n, k), known)
        out.append(2 * (1 - value))
        known = np.concatenate([known, vector[None]])
    return np.array(out)


def _bisect(g: Graph, nodes: np.ndarray, least: int) -> tuple[float, np.ndarray, np.ndarray] | None:
    """The better of the best contiguous cut and the best cut along the second eigenvector; ties to the first."""
    if len(nodes) < 2 * least:
        return None
    own = g.part(nodes)
    orders = [np.arange(own.n)]
    if (own.degree() > 0).all():
        orders.append(np.argsort(second_vector(own), kind="stable"))
    best = None
    for order in orders:
        found = _sweep(own, order, least)
        if found and (best is None or found[0] < best[0] - 1e-12):
            best = (found[0], np.sort(nodes[order[: found[1]]]), np.sort(nodes[order[found[1] :]]))
    return best


def cut_of(g: Graph, a: np.ndarray, b: np.ndarray) -> float:
    """The normalised cut of two given parts on a graph; infinite where one has no edges."""
    side = np.zeros(g.n, dtype=np.int64)
    side[a], side[b] = 1, 2
    x, y = side[g.i], side[g.j]
    inside = (x > 0) & (y > 0)
    volumes = [g.w[inside & (x == s)].sum() for s in (1, 2)]
    cut = g.w[inside & (x != y)].sum() / 2
    return float(cut / volumes[0] + cut / volumes[1]) if min(volumes) > 0 else np.inf


def crossing(pairs: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> int:
    """How many of the pairs (k, 2) two parts take apart."""
    side = np.zeros(n, dtype=np.int64)
    side[a], side[b] = 1, 2
    return int((side[pairs[:, 0]] * side[pairs[:, 1]] == 2).sum())


def eigengap(g: Graph, most: int = MOST) -> int:
    """How many parts the spectrum suggests: the first largest gap between Laplacian eigenvalues."""
    values = np.concatenate([[0.0], spectrum(g, most)])
    return int(np.argmax(np.round(np.diff(values)[:most], 9))) + 1 if len(values) > 2 else 1


def absorbed(g: Graph, label: np.ndarray, least: int = LEAST, short: int = SHORT) -> np.ndarray:
    """Runs under ``short`` join the domain they touch most, the shortest first; a run that is its whole domain needs ``least``.

    Ties go to the lowest domain, and a run without contact to another stays.
    """
    label = label.copy()
    for _ in range(len(label)):
        begin = np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1])
        length = np.diff(np.append(begin, len(label)))
        floor = np.where(length == np.bincount(label)[label[begin]], least, short)
        small = np.flatnonzero(length < floor)
        if not len(small):
            break
        k = small[np.argmin(length[small])]
        run = slice(begin[k], begin[k] + length[k])
        edges = g.of_rows(run.start, run.stop)
        pull = np.bincount(label[g.j[edges]], g.w[edges], minlength=label.max() + 1)
        pull[label[run.start]] = 0
        if pull.max() <= 0:
            break
        label[run] = int(np.argmax(pull))
    return label


def trimmed(g: Graph, label: np.ndarray, degree: int, apart: int = 4, least: int = LEAST, keep: float = 0.45) -> np.ndarray:
    """Ends with under ``degree`` contacts of more than ``apart`` residues inside their domain are unassigned (-1), the looser end first."""
    label = label.copy()
    far = (g.w > 0) & (np.abs(g.i - g.j) > apart)
    for d in np.unique(label[label >= 0]):
        own = np.flatnonzero(label == d)
        floor = max(least, int(np.ceil(keep * len(own))))
        count = np.bincount(g.i[far & (label[g.i] == d) & (label[g.j] == d)], minlength=g.n)
        lo, hi = 0, len(own) - 1
        while hi - lo + 1 > floor:
            end = lo if count[own[lo]] <= count[own[hi]] else hi
            if count[own[end]] >= degree:
                break
            label[own[end]] = -1
            edges = g.of_rows(own[end], own[end] + 1)
            np.subtract.at(count, g.j[edges][far[edges]], 1)
            lo, hi = (lo + 1, hi) if end == lo else (lo, hi - 1)
    return label


def renumbered(label: np.ndarray) -> np.ndarray:
    """Domains numbered by their first residue; -1 stays."""
    names, first = np.unique(label, return_index=True)
    order = [x for x in names[np.argsort(first)] if x >= 0]
    place = {x: k for k, x in enumerate(order)} | {-1: -1}
    return np.array([place[x] for x in label], dtype=np.int64)


def labels_of(
    g: Graph,
    ceilings: list[float],
    least: int = LEAST,
    most: int = MOST,
    short: int = SHORT,
    scale: float = 0.0,
    by_spectrum: bool = False,
    trim: int = 0,
    sheet: np.ndarray | None = None,
    veto: int = 0,
    others: tuple[Graph, ...] = (),
) -> list[np.ndarray]:
    """Domain of each point for each ceiling: while a part can be cut under it, the cheapest cut is made.

    ``scale`` raises the ceiling of short parts; ``by_spectrum`` cuts to the count of the
    spectrum whatever a cut costs; ``trim`` unassigns loose ends.  From the second cut on a cut
    that takes ``veto`` pairs of ``sheet`` apart is passed over, and the next cheapest made.  A cut
    counts with its mean over the graph and ``others``.
    """
    memo: dict[bytes, tuple | None] = {}

    def cut(part: np.ndarray) -> tuple | None:
        key = part.tobytes()
        if key not in memo:
            found = _bisect(g, part, least)
            if found is not None and others:
                scores = [found[0], *(cut_of(o, *found[1:]) for o in others)]
                found = (float(np.mean([x for x in scores if np.isfinite(x)])), *found[1:])
            memo[key] = found
        return memo[key]

    limit = min(most, eigengap(g, most)) if by_spectrum else most
    out = []
    for ceiling in ceilings:
        parts = [np.arange(g.n)]
        while len(parts) < limit:
            cuts = []
            for k, part in enumerate(parts):
                found = cut(part)
                allowed = np.inf if by_spectrum else ceiling * (CEILING_LENGTH / max(1, len(part))) ** (scale / 3)
                if found is None or found[0] > allowed:
                    continue
                if veto and sheet is not None and not by_spectrum and len(parts) > 1 and crossing(sheet, g.n, *found[1:]) >= veto:
                    continue
                cuts.append((found[0], k))
            if not cuts:
                break
            k = min(cuts)[1]
            parts[k : k + 1] = cut(parts[k])[1:]
        label = np.zeros(g.n, dtype=np.int64)
        for at, part in enumerate(parts):
            label[part] = at
        label = absorbed(g, label, least, short)
        out.append(renumbered(trimmed(g, label, trim, least=least) if trim else label))
    return out


_SHEET = -1


def parse(points: DataFrame, key: str, ceilings: tuple[float, ...] = (MAX_CUT,), distance: float = 8.0, edges: DataFrame | None = None, veto: int = 0, score_runs: int = 1, packed: bool = False, **how) -> DataFrame:
    """(key, rung, i, label): the domains of each chain under each ceiling, numbered by first residue; if ``packed`` (key, rung, labels), a row for each ceiling.

    ``edges`` (key, i, j, w) replace the soft contacts of ``distance``.  ``veto`` is the number of
    sheet pairs that a later cut may not take apart.  With ``score_runs`` a cut is scored on that
    many graphs, the first as it is and the others of perturbed copies.  ``how`` is passed to
    ``labels_of``.
    """
    own = (G.soft_contacts(points, key, distance) if edges is None else edges).select(key, F.lit(0).alias("run"), "i", "j", "w")
    # a row for each chain's last residue, so that every residue is numbered
    rows = own.unionByName(points.groupBy(key).agg(F.max("i").alias("i")).select(key, F.lit(0).alias("run"), "i", F.col("i").alias("j"), F.lit(0.0).alias("w")))
    if veto:
        rows = rows.unionByName(G.beta_pairs(points, key).select(key, F.lit(_SHEET).alias("run"), "i", "j", F.lit(0.0).alias("w")))
    if score_runs > 1:
        rows = rows.unionByName(perturbed_contacts(points, key, score_runs, distance, "score").where("run > 0"))
    steps = [float(c) for c in ceilings]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf["run"] == 0]
        n = int(max(first["i"].max(), first["j"].max())) + 1
        graph = lambda p: Graph.of(n, p["i"].to_numpy(), p["j"].to_numpy(), p["w"].to_numpy())
        sheet = pdf.loc[pdf["run"] == _SHEET, ["i", "j"]].to_numpy()
        others = tuple(graph(p) for run, p in pdf.groupby("run") if run > 0)
        found = labels_of(graph(first[first["w"] > 0]), steps, sheet=sheet, veto=veto, others=others, **how)
        if packed:
            return pd.DataFrame({key: pdf[key].iloc[0], "rung": range(len(found)), "labels": found})
        return pd.concat([pd.DataFrame({key: pdf[key].iloc[0], "rung": r, "i": np.arange(n), "label": x}) for r, x in enumerate(found)])

    kind = points.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(one, f"`{key}` {kind}, rung int, " + ("labels array<int>" if packed else "i int, label int"))


def jittered(points: DataFrame, key: str, runs: int, sigma: float = NOISE, use: str = "vote") -> DataFrame:
    """``points`` once for each run, run 0 as they are, the others moved by normal noise that depends on place and run alone."""
    rows = points.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    first, step = RUN_SEEDS[use]
    seed = F.lit(first) + F.col("run") * F.lit(step)
    noise = lambda k: X.seeded_normal(seed, 3 * F.col("i").cast("long") + k)
    moved = [F.when(F.col("run") == 0, F.col(c)).otherwise(F.col(c) + sigma * noise(k)).alias(c) for k, c in enumerate(G.XYZ)]
    # a generator is not merged with what follows, so the noise is drawn once and not for every use of a coordinate
    return rows.select(key, "run", "i", F.inline(F.array(F.struct(*moved))))


def perturbed_contacts(points: DataFrame, key: str, runs: int, distance: float = 8.0, use: str = "graph", sigma: float = NOISE, shift: float = CUT_SHIFT) -> DataFrame:
    """(key, run, i, j, w): soft contacts of perturbed copies, whose distance moves by -1, 0 or 1 times ``shift``; run 0 is unperturbed."""
    moved = cut(jittered(points, key, runs, sigma, use)).withColumn("_copy", F.struct(F.col(key).alias("k"), F.col("run").alias("r")))
    run = F.col("_copy.r")
    turn = F.when(run == 0, 0).otherwise(run % 3 - 1)
    out = G.soft_contacts(moved.select("_copy", "i", *G.XYZ), "_copy", distance + turn * F.lit(shift), widest=distance + abs(shift))
    return out.select(F.col("_copy.k").alias(key), run.alias("run"), "i", "j", "w")


def averaged_contacts(points: DataFrame, key: str, runs: int, distance: float = 8.0) -> DataFrame:
    """(key, i, j, w): contacts averaged over perturbed copies; a copy without one counts 0."""
    return perturbed_contacts(points, key, runs, distance).groupBy(key, "i", "j").agg((F.sum("w") / runs).alias("w"))


def learned_contacts(edges: DataFrame, vectors: DataFrame, key: str, power: float = 6.0) -> DataFrame:
    """``edges`` (key, i, j, w) weighed by ((1 + c) / 2) to ``power``, c the cosine of the vectors of both ends; neighbours keep their weight.

    ``vectors`` has (key, i, v), and run where there are several of perturbed copies: then c is
    their mean.  A chain's edges lie in blocks of VECTOR_BLOCK residues, and a vector goes once to
    each block that has an edge of its residue, not to the edges.  A zero vector has cosine 0;
    edges of residues without a vector keep their weight.
    """
    rows = vectors if "run" in vectors.columns else vectors.withColumn("run", F.lit(0))
    kind = edges.schema[key].dataType.simpleString()

    def weigh(e: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(e):
            return e[[key, "i", "j", "w"]]
        total, seen = np.zeros(len(e)), np.zeros(len(e))
        i, j = e["i"].to_numpy(), e["j"].to_numpy()
        names = np.unique(np.concatenate([i, j]))
        at, to = np.searchsorted(names, i), np.searchsorted(names, j)
        for _, own in v.groupby("run"):
            width = len(own["v"].iloc[0])
            unit, held = np.zeros((len(names), width)), np.zeros(len(names), dtype=bool)
            place = np.searchsorted(names, own["i"].to_numpy())
            unit[place], held[place] = np.stack(own["v"].to_list()), True
            unit /= np.where((size := np.linalg.norm(unit, axis=1)) > 0, size, 1)[:, None]
            for lo in range(0, len(e), 65536):
                part = slice(lo, lo + 65536)
                both = held[at[part]] & held[to[part]]
                total[part] += np.where(both, (unit[at[part]] * unit[to[part]]).sum(axis=1), 0)
                seen[part] += both
        cosine = total / np.maximum(seen, 1)
        factor = np.where((seen > 0) & (np.abs(i - j) != 1), ((1 + np.clip(cosine, -1, 1)) / 2) ** power, 1.0)
        return pd.DataFrame({key: e[key].to_numpy(), "i": i, "j": j, "w": e["w"].to_numpy() * factor})

    block = F.floor(F.col("i") / VECTOR_BLOCK).alias("_block")
    own = edges.select(key, "i", "j", "w", block)
    wanted = own.select(key, "_block", F.explode(F.array("i", "j")).alias("i")).distinct()
    sent = wanted.join(rows.select(key, "run", F.col("i").cast("int").alias("i"), "v").hint("merge"), [key, "i"]).select(F.col(key).alias("_chain"), F.col("_block").alias("_part"), "run", F.col("i").alias("i"), "v")
    return own.groupBy(key, "_block").cogroup(sent.groupBy("_chain", "_part")).applyInPandas(weigh, f"`{key}` {kind}, i int, j int, w double")


def consensus_runs(points: DataFrame, key: str, runs: int = 5, distance: float = 8.0, packed: bool = False) -> DataFrame:
    """(key, run, i, label) of perturbed parses, or (key, run, labels) if ``packed``; votes over them are in ``segments``."""
    edges = perturbed_contacts(points, key, runs, distance, "vote")
    copy = lambda df: df.withColumn("_copy", F.struct(F.col(key).alias("k"), F.col("run").alias("r")))
    every = copy(points.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))))
    name = F.to_json("_copy")
    found = parse(every.withColumn("_copy", name), "_copy", edges=copy(edges).withColumn("_copy", name), packed=packed)
    back = F.from_json("_copy", every.schema["_copy"].dataType.simpleString())
    return found.select(back["k"].alias(key), back["r"].alias("run"), *(["labels"] if packed else ["i", "label"]))


def plateaus(rungs: DataFrame, key: str) -> DataFrame:
    """Runs of equal signatures over neighbouring rungs: (key, first, last, length, signature)."""
    w = Window.partitionBy(key).orderBy("rung")
    new = F.coalesce((F.lag("signature").over(w) != F.col("signature")).cast("int"), F.lit(1))
    rows = rungs.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_run", "signature").agg(F.min("rung").alias("first"), F.max("rung").alias("last"), F.count("*").alias("length")).drop("_run")
