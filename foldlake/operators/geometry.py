"""Chains of points: contacts, torsions, secondary structure, and scores of contiguous cuts.

A chain is the rows of one key, numbered from 0 in ``i``, with x, y and z.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def contacts(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(key, i, j, d2): ordered pairs of a chain within ``radius``, each point with itself too.

    Points meet through a grid of cells twice as wide as the radius, so that a point reaches one
    neighbour along each axis.  It is copied to those of the eight cells that come after its own,
    4.5 with its own on average, and a pair of two cells is made once and turned.  The sides are
    sorted and merged: their sizes before the copies are made would have them broadcast.
    """
    # a little wider, so that no rounding of a quotient hides a pair at the radius
    width = 2 * radius * (1 + 1e-9)
    own = [F.floor(F.col(c) / width) for c in XYZ]
    near = [F.when(F.col(c) - cell * F.lit(width) < radius, -1).otherwise(1) for c, cell in zip(XYZ, own, strict=True)]
    left = points.select(F.col(key), "i", *XYZ, *[c.alias(f"c{n}") for c, n in zip(own, XYZ, strict=True)])
    right = points.select(F.col(key).alias("_key"), F.col("i").alias("j"), *[F.col(c).alias(f"{c}2") for c in XYZ], *[c.alias(f"c{n}") for c, n in zip(own, XYZ, strict=True)], *[c.alias(f"n{n}") for c, n in zip(near, XYZ, strict=True)])
    offsets = F.array(*[F.struct(*[(F.col(f"n{n}") if v else F.lit(0)).alias(f"d{n}") for v, n in zip((a, b, c), XYZ, strict=True)]) for a in (0, 1) for b in (0, 1) for c in (0, 1)])
    # the first axis that differs says which of two cells comes after the other
    after = F.filter(offsets, lambda o: F.when(o["dx"] != 0, o["dx"] > 0).when(o["dy"] != 0, o["dy"] > 0).otherwise(o["dz"] >= 0))
    right = right.withColumn("o", F.explode(after))
    away = (F.col("o.dx") != 0) | (F.col("o.dy") != 0) | (F.col("o.dz") != 0)
    right = right.select("_key", "j", *[f"{c}2" for c in XYZ], *[(F.col(f"c{c}") + F.col(f"o.d{c}")).alias(f"e{c}") for c in XYZ], away.alias("_away"))
    on = [F.col(key) == F.col("_key"), *[F.col(f"c{n}") == F.col(f"e{n}") for n in XYZ]]
    d2 = sum((F.col(c) - F.col(f"{c}2")) ** 2 for c in XYZ)
    pairs = left.join(right.hint("merge"), on).select(key, "i", "j", d2.alias("d2"), "_away").where(F.col("d2") <= radius * radius)
    ways = F.when(F.col("_away"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j")))
    return pairs.select(key, "d2", F.inline(ways)).select(key, "i", "j", "d2")


def degrees(edges: DataFrame, key: str) -> DataFrame:
    """(key, i, degree, share): contacts of each point, and that over the chain's largest."""
    n = edges.groupBy(key, "i").agg(F.count("*").alias("degree"))
    return n.withColumn("share", F.col("degree") / F.max("degree").over(Window.partitionBy(key)))


def _ahead(name: str, k: int, w) -> Column:
    return F.lead(name, k).over(w) if k >= 0 else F.lag(name, -k).over(w)


def _minus(a: tuple, b: tuple) -> tuple:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def _cross(a: tuple, b: tuple) -> tuple:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def torsions(points: DataFrame, key: str) -> DataFrame:
    """``points`` with tau: the dihedral of the point before, the point and the two after, over pi; 0 at the ends."""
    w = Window.partitionBy(key).orderBy("i")
    names = [f"{c}{k}" for k in range(4) for c in XYZ]
    rows = points.select("*", *[_ahead(c, k - 1, w).alias(f"{c}{k}") for k in range(4) for c in XYZ])
    p = [tuple(F.col(f"{c}{k}") for c in XYZ) for k in range(4)]
    ab, bc, cd = _minus(p[1], p[0]), _minus(p[2], p[1]), _minus(p[3], p[2])
    n1, n2 = _cross(ab, bc), _cross(bc, cd)
    length = F.greatest(F.sqrt(_dot(bc, bc)), F.lit(1e-12))
    along = tuple(c / length for c in bc)
    tau = F.atan2(_dot(_cross(n1, n2), along), _dot(n1, n2)) / math.pi
    return rows.withColumn("tau", F.coalesce(tau, F.lit(0.0))).drop(*names)


def position_code(i: Column, width: int = 64, base: float = 2000.0) -> Column:
    """Sines, then cosines, of the 1-based position at width / 2 frequencies."""
    half = F.sequence(F.lit(0), F.lit(width // 2 - 1))
    angle = lambda k: (i + 1) * F.pow(F.lit(base), -2.0 * k / width)
    return F.concat(F.transform(half, lambda k: F.sin(angle(k))), F.transform(half, lambda k: F.cos(angle(k))))


def breaks(points: DataFrame, key: str, limit: float = 25.0) -> DataFrame:
    """``points`` with run: a new one begins where the squared step from the point before exceeds ``limit``."""
    w = Window.partitionBy(key).orderBy("i")
    d2 = sum((F.col(c) - F.lag(c).over(w)) ** 2 for c in XYZ)
    new = F.coalesce((d2 > limit).cast("int"), F.lit(0))
    return points.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


# Distances of a five-point window (first-third, first-fourth, first-fifth,
# second-fourth, second-fifth, third-fifth) in an ideal helix and strand, and their tolerances.
HELIX = (5.45, 5.18, 6.37, 5.45, 5.18, 5.45)
STRAND = (6.1, 10.4, 13.0, 6.1, 10.4, 6.1)
HELIX_WITHIN, STRAND_WITHIN, TURN = 2.1, 1.42, 8.0


def secondary_structure(points: DataFrame, key: str) -> DataFrame:
    """``points`` with ss: H, E, T or C from the distances inside a window of five; the two at each end are C."""
    w = Window.partitionBy(key).orderBy("i")
    at = {k: tuple(_ahead(c, k, w) for c in XYZ) for k in range(-2, 3)}
    gap = lambda a, b: F.sqrt(_dot(_minus(at[a], at[b]), _minus(at[a], at[b])))
    six = [(-2, 0), (-2, 1), (-2, 2), (-1, 1), (-1, 2), (0, 2)]
    rows = points.select("*", *[gap(a, b).alias(f"_g{k}") for k, (a, b) in enumerate(six)])

    def like(ideal: tuple, within: float) -> Column:
        out = F.lit(True)
        for k, d in enumerate(ideal):
            out = out & (F.abs(F.col(f"_g{k}") - d) < within)
        return out

    ss = F.when(F.col("_g2").isNull(), "C").when(like(HELIX, HELIX_WITHIN), "H").when(like(STRAND, STRAND_WITHIN), "E").when(F.col("_g2") < TURN, "T").otherwise("C")
    return rows.withColumn("ss", ss).drop(*[f"_g{k}" for k in range(6)])


def smoothed(sequence: Column) -> Column:
    """A structure string with gaps of one bridged from left to right, then lone H and E dropped.

    A bridge makes three alike, so the next one can begin with its last at the earliest; and
    dropping a lone one leaves no other lone.  Hence one pass each.
    """
    bridged = F.regexp_replace(sequence, r"([HE])(?!\1).(?=\1)", "$1$1")
    return F.regexp_replace(bridged, r"(?<!H)H(?!H)|(?<!E)E(?!E)", "C")


def virtual_side(points: DataFrame, key: str, offset: float = 3.5) -> DataFrame:
    """Points moved out along the bend of the chain: (key, i, x, y, z); straight or single points move along z."""
    w = Window.partitionBy(key).orderBy("i")
    rows = points
    for c in XYZ:
        back, front = F.col(c) - F.lag(c).over(w), F.col(c) - F.lead(c).over(w)
        rows = rows.withColumn(f"_v{c}", F.coalesce(back, F.lit(0.0)) + F.coalesce(front, F.lit(0.0)))
    m = F.sqrt(sum(F.col(f"_v{c}") ** 2 for c in XYZ))
    out = {c: F.when(m < 1e-6, F.lit(1.0 if c == "z" else 0.0)).otherwise(F.col(f"_v{c}") / m) for c in XYZ}
    return rows.select(key, "i", *[(F.col(c) + offset * out[c]).alias(c) for c in XYZ])


def _taper(d: Column, distance: Column | float, soft: float) -> Column:
    """1 up to distance - soft, 0 from distance + soft on, half a cosine between."""
    return F.when(d <= distance - soft, 1.0).when(d < distance + soft, (1 + F.cos(math.pi * (d - (distance - soft)) / (2 * soft))) / 2).otherwise(0.0)


def soft_contacts(points: DataFrame, key: str, *distances: Column | float, soft: float = 1.0, backbone: float = 2.0, widest: float | None = None, carried: str | None = None) -> DataFrame:
    """(key, i, j, w), both ways: ``backbone`` between neighbours, else 1 up to distance - soft and 0 from distance + soft on.

    The distance is 8 unless given.  Over several ``distances`` w is the mean of their weights,
    out of one search of the widest; one told by the key is a column, and ``widest`` its largest
    value.  A column ``carried`` by the points comes along as _a for i and _b for j.
    """
    distances = distances or (8.0,)
    widest = max(distances) if widest is None else widest
    d = F.sqrt("d2")
    w = sum(_taper(d, x, soft) for x in distances) / len(distances)
    point = F.struct("i", carried) if carried else F.struct("i")
    ends = lambda a, b: [F.col(f"{a}.i").alias("i"), F.col(f"{b}.i").alias("j"), *([F.col(f"{a}.{carried}").alias("_a"), F.col(f"{b}.{carried}").alias("_b")] if carried else [])]
    near = contacts(points.select(key, point.alias("i"), *XYZ), key, widest + soft).where(F.abs(F.col("i.i") - F.col("j.i")) > 1)
    pairs = near.select(key, *ends("i", "j"), w.alias("w")).where("w > 0")
    n = Window.partitionBy(key).orderBy("i")
    steps = points.select(key, point.alias("p"), F.lead(point).over(n).alias("q")).where("q is not null").withColumn("w", F.lit(backbone))
    return pairs.unionByName(steps.select(key, *ends("p", "q"), "w")).unionByName(steps.select(key, *ends("q", "p"), "w"))


def beta_pairs(points: DataFrame, key: str, within: float = 5.5, apart: int = 5) -> DataFrame:
    return contacts(points, key, within).where(F.col("j") - F.col("i") >= apart).select(key, "i", "j", "d2")


def cut_profile(edges: DataFrame, key: str, n: DataFrame, least: int = 40) -> DataFrame:
    """(key, k, ncut): the normalised cut of [0, k) against the rest; null under ``least`` from an end or without volume.

    Every edge lies in ``edges`` both ways; ``n`` has (key, n).  Running sums over the nodes
    move each node's edges from one side of the cut to the other.
    """
    node = edges.groupBy(key, "i").agg(F.sum("w").alias("deg"), F.sum(F.when(F.col("j") < F.col("i"), -F.col("w")).otherwise(F.col("w"))).alias("step"))
    every = n.select(key, "n", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("i"))
    node = every.join(node, [key, "i"], "left").fillna(0.0, ["deg", "step"])
    upto = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    sums = node.withColumn("a", F.sum("deg").over(upto)).withColumn("cut", F.sum("step").over(upto)).withColumn("total", F.sum("deg").over(whole))
    k, b = F.col("i") + 1, F.col("total") - F.col("a")
    ok = (k >= least) & (F.col("n") - k >= least) & (F.col("a") > 0) & (b > 0)
    return sums.where("i < n - 1").select(key, k.alias("k"), F.when(ok, F.col("cut") / F.col("a") + F.col("cut") / b).alias("ncut"))


def spread_penalty(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, penalty): radius of gyration over 2.2 n^0.38, at least 1."""
    sums = points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in XYZ], F.avg(sum(F.col(c) ** 2 for c in XYZ)).alias("sq"))
    rg = F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - sum(F.col(f"m{c}") ** 2 for c in XYZ)))
    return sums.select(*keys, "n", F.greatest(F.lit(1.0), rg / (2.2 * F.pow(F.col("n").cast("double"), 0.38))).alias("penalty"))


def covariance(points: DataFrame, key: str) -> DataFrame:
    """(key, n, xx, xy, xz, yy, yz, zz): sums of products about the mean."""
    pairs = [(a, b) for k, a in enumerate(XYZ) for b in XYZ[k:]]
    sums = points.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{c}") for c in XYZ], *[F.sum(F.col(a) * F.col(b)).alias(f"p{a}{b}") for a, b in pairs])
    return sums.select(key, "n", *[(F.col(f"p{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / F.col("n")).alias(f"{a}{b}") for a, b in pairs])


def principal_axes(points: DataFrame, key: str) -> DataFrame:
    """(key, axes, spread): three unit axes, the longest first and right-handed, and the deviation along each."""
    names = ("xx", "xy", "xz", "yy", "yz", "zz")

    @F.pandas_udf("axes array<double>, spread array<double>")
    def turned(n: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
        values, vectors = np.linalg.eigh(m)
        axes = vectors[:, :, ::-1].transpose(0, 2, 1)
        axes[:, 2] *= np.sign(np.linalg.det(axes))[:, None]
        spread = np.sqrt(np.maximum(values[:, ::-1], 0) / n.to_numpy()[:, None])
        return pd.DataFrame({"axes": list(axes.reshape(-1, 9)), "spread": list(spread)})

    return covariance(points, key).select(key, turned("n", *names).alias("a")).select(key, "a.axes", "a.spread")


def fields(points: DataFrame, pairs: DataFrame, key: str, value: Callable[[Column, Column], Column], *columns: str, cells: int = 480_000) -> DataFrame:
    """(q, t, i, j, value) for each pair (q, t) of chains, at the stride that keeps its field under ``cells``.

    ``value`` is of the structs of ``columns`` of either point.  Pairs meet by an equi-join on
    the pair, so a task holds fields of that size and the result follows the pairs.
    """
    sizes = points.groupBy(key).agg(F.count("*").alias("_n"))
    sized = pairs.join(sizes.select(F.col(key).alias("q"), F.col("_n").alias("_nq")), "q").join(sizes.select(F.col(key).alias("t"), F.col("_n").alias("_nt")), "t")
    stride = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("_nq").cast("double") * F.col("_nt") / cells)))
    sized = sized.select("q", "t", stride.alias("_stride"))
    point = points.select(F.col(key).alias("_key"), F.col("i"), F.struct(*columns).alias("_p"))
    sides = []
    for end, i, p in (("q", "i", "_a"), ("t", "j", "_b")):
        own = sized.join(point, F.col(end) == F.col("_key")).where(F.col("i") % F.col("_stride") == 0)
        sides.append(own.select("q", "t", F.col("i").alias(i), F.col("_p").alias(p)))
    return sides[0].join(sides[1], ["q", "t"]).select("q", "t", "i", "j", value(F.col("_a"), F.col("_b")).alias("value"))
