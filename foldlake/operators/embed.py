"""Chains to vectors by a message-passing network over their contact graph.

Spark builds the graph and the features; the network runs per chain on matrices, with the
first edge layer factorised into a part for either end and one for the distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import geometry as G

LAYERS, WIDTH, HIDDEN, MESSAGE, FEATURES = 6, 128, 256, 64, 68


def layout() -> dict[str, tuple[int, ...]]:
    """Names and shapes of the network's tensors in their stored order."""
    out: dict[str, tuple[int, ...]] = {}

    def linear(name: str, rows: int, columns: int) -> None:
        out[f"{name}.weight"] = (rows, columns)
        out[f"{name}.bias"] = (rows,)

    linear("node_enc", WIDTH, FEATURES)
    for k in range(LAYERS):
        linear(f"layers.{k}.edge_mlp.0", HIDDEN, 2 * WIDTH + 1)
        linear(f"layers.{k}.edge_mlp.3", MESSAGE, HIDDEN)
        linear(f"layers.{k}.node_mlp.0", HIDDEN, WIDTH + MESSAGE)
        linear(f"layers.{k}.node_mlp.3", WIDTH, HIDDEN)
    linear("node_dec.0", WIDTH, WIDTH)
    linear("node_dec.3", WIDTH, WIDTH)
    linear("graph_dec.0", WIDTH, WIDTH)
    linear("graph_dec.4", WIDTH, WIDTH)
    return out


def load(data: bytes, shapes: dict[str, tuple[int, ...]] | None = None) -> dict[str, np.ndarray]:
    """Tensors from consecutive half floats; too few or too many are an error."""
    flat = np.frombuffer(data, dtype="<f2").astype(np.float32)
    shapes, at, out = shapes or layout(), 0, {}
    for name, shape in shapes.items():
        n = int(np.prod(shape))
        if at + n > len(flat):
            raise ValueError(f"no data for {name}")
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    if at != len(flat):
        raise ValueError(f"{len(flat) - at} values are left over")
    return out


def seeded(seed: int = 11) -> dict[str, np.ndarray]:
    """Weights drawn from a seed, for use without trained ones."""
    rng = np.random.default_rng(seed)
    return {n: (rng.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32) if len(s) > 1 else np.zeros(s, np.float32) for n, s in layout().items()}


def _silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-np.clip(x, -60, 60)))


def _linear(w: dict[str, np.ndarray], name: str, x: np.ndarray) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def encode(features: np.ndarray, i: np.ndarray, j: np.ndarray, d2: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(residue vectors, norms of the messages by layer and edge); edges are directed, in the order of i, and hold each residue with itself."""
    first = np.searchsorted(i, np.arange(len(features)))
    h, norms = _linear(w, "node_enc", features), []
    for k in range(LAYERS):
        edge = w[f"layers.{k}.edge_mlp.0.weight"]
        own, other = h @ edge[:, :WIDTH].T, h @ edge[:, WIDTH : 2 * WIDTH].T
        m = _silu(own[i] + other[j] + d2[:, None] * edge[:, 2 * WIDTH] + w[f"layers.{k}.edge_mlp.0.bias"])
        m = _silu(_linear(w, f"layers.{k}.edge_mlp.3", m))
        norms.append(np.linalg.norm(m, axis=1))
        m = np.add.reduceat(m, first, axis=0)
        h = h + _linear(w, f"layers.{k}.node_mlp.3", _silu(_linear(w, f"layers.{k}.node_mlp.0", np.concatenate([h, m], axis=1))))
    return _linear(w, "node_dec.3", _silu(_linear(w, "node_dec.0", h))), np.stack(norms)


def decode(pooled: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Vectors of length 1 of summed residue vectors, one for each row."""
    out = _linear(w, "graph_dec.4", _silu(_linear(w, "graph_dec.0", pooled)))
    return out / np.maximum(np.linalg.norm(out, axis=-1, keepdims=True), 1e-12)


def forward(features: np.ndarray, i: np.ndarray, j: np.ndarray, d2: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(vector of length 1, norms of the residues' parts); edges are directed and hold each residue with itself."""
    order = np.argsort(i, kind="stable")
    parts, _ = encode(features, i[order], j[order], d2[order].astype(np.float32), w)
    return decode(parts.sum(axis=0, dtype=np.float64), w), np.linalg.norm(parts, axis=1)


def graph(points: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Features (key, i, features) and edges (key, i, j, d2) of chains of four residues or more."""
    sized = points.groupBy(key).agg(F.count("*").alias("_n")).where("_n >= 4").select(key)
    kept = points.join(sized, key, "left_semi")
    edges = G.contacts(kept, key, 10.0)
    last = F.max("i").over(Window.partitionBy(key))
    nodes = G.torsions(kept, key).withColumn("_last", last).join(G.degrees(edges, key).hint("merge"), [key, "i"])
    ends = [(F.col("i") == 0).cast("double"), (F.col("i") == F.col("_last")).cast("double")]
    features = F.concat(F.array(F.col("share"), *ends, F.col("tau")), G.position_code(F.col("i")))
    return nodes.select(key, "i", features.alias("features")), edges


def embed(points: DataFrame, key: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """(key, embedding, contribution): the vector of each chain, and each residue's norm from 0 to 1.

    Contributions are scaled by their extremes, and 0.5 where all are equal.
    """
    nodes, edges = graph(points, key)
    shared = points.sparkSession.sparkContext.broadcast(weights)

    def one(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("i", ignore_index=True)
        vector, norms = forward(np.stack(n["features"].to_numpy()).astype(np.float32), e["i"].to_numpy(), e["j"].to_numpy(), e["d2"].to_numpy(), shared.value)
        span = norms.max() - norms.min()
        scaled = (norms - norms.min()) / span if span > 0 else np.full(len(norms), 0.5)
        return pd.DataFrame({key: [n[key].iloc[0]], "embedding": [vector.astype(float)], "contribution": [scaled.astype(float)]})

    kind = points.schema[key].dataType.simpleString()
    own = edges.select(F.col(key).alias("_chain"), F.col("i").alias("i"), F.col("j").alias("j"), F.col("d2").alias("d2"))
    return nodes.groupBy(key).cogroup(own.groupBy("_chain")).applyInPandas(one, f"`{key}` {kind}, embedding array<double>, contribution array<double>")


def _by_chain(points: DataFrame, key: str, weights: dict[str, np.ndarray], made: str, rows) -> DataFrame:
    """(key, ``made``): what ``rows`` makes of each chain's residue vectors, message norms and edges."""
    nodes, edges = graph(points, key)
    shared = points.sparkSession.sparkContext.broadcast(weights)

    def one(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n, e = n.sort_values("i", ignore_index=True), e.sort_values(["i", "j"], ignore_index=True)
        found = encode(np.stack(n["features"].to_numpy()).astype(np.float32), e["i"].to_numpy(), e["j"].to_numpy(), e["d2"].to_numpy(np.float32), shared.value)
        out = rows(n, e, *found)
        out.insert(0, key, n[key].iloc[0])
        return out

    kind = points.schema[key].dataType.simpleString()
    own = edges.select(F.col(key).alias("_chain"), F.col("i").alias("i"), F.col("j").alias("j"), F.col("d2").alias("d2"))
    return nodes.groupBy(key).cogroup(own.groupBy("_chain")).applyInPandas(one, f"`{key}` {kind}, {made}")


def residue_vectors(points: DataFrame, key: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """(key, i, vector): what each residue adds to the pooled vector of its chain."""
    return _by_chain(points, key, weights, "i int, vector array<double>", lambda n, e, parts, norms: pd.DataFrame({"i": n["i"], "vector": list(parts.astype(float))}))


def message_norms(points: DataFrame, key: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """(key, layer, i, j, norm) of the message along each directed contact; the two ways differ."""

    def rows(n: pd.DataFrame, e: pd.DataFrame, parts: np.ndarray, norms: np.ndarray) -> pd.DataFrame:
        own = [pd.DataFrame({"layer": k, "i": e["i"], "j": e["j"], "norm": norms[k].astype(float)}) for k in range(len(norms))]
        return pd.concat(own, ignore_index=True)

    return _by_chain(points, key, weights, "layer int, i int, j int, norm double", rows)


def pooled(vectors: DataFrame, members: DataFrame, key: str, part: str, weights: dict[str, np.ndarray], least: int = 4) -> DataFrame:
    """(key, part, nres, too_short, embedding) of parts of chains, ``members`` being (key, part, i).

    The vectors come from the whole chain, so this is not the embedding of the part alone.
    A part of fewer than ``least`` residues is kept, marked, and has no embedding.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(weights)
    sums = [F.sum(F.get("vector", F.lit(k))) for k in range(WIDTH)]
    rows = members.join(vectors, [key, "i"], "left").groupBy(key, part).agg(F.count("*").alias("nres"), F.array(*sums).alias("_sum"))

    @F.pandas_udf("array<double>")
    def decoded(total: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(total), dtype=object)
        some = [k for k, x in enumerate(total) if x is not None and not any(v is None or v != v for v in x)]
        if some:
            for k, v in zip(some, decode(np.stack([np.asarray(total.iloc[k], dtype=np.float64) for k in some]), shared.value), strict=True):
                out.iloc[k] = v.astype(float)
        return out

    short = F.col("nres") < least
    return rows.select(key, part, "nres", short.alias("too_short"), F.when(~short, decoded("_sum")).alias("embedding"))
