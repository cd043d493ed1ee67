"""Queries over the chains that the embeddings trace."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import domains as D
from ..operators import geometry as G
from ..operators import segments as S
from ..plans.views import TRACE_SQL, table, trace


def _trace(spark, d):
    return trace(table(spark, d, "embeddings"))


def _r(c, digits=6):
    return F.round(F.col(c), digits).alias(c)


def trace_contacts(spark, d):
    return G.contacts(_trace(spark, d), "label", 10.0).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("j") - F.col("i") >= 4).alias("far"))


def contact_degree_norm(spark, d):
    return G.degrees(G.contacts(_trace(spark, d), "label", 10.0), "label").select("label", "i", "degree", _r("share"))


def torsion_tau(spark, d):
    return G.torsions(_trace(spark, d), "label").select("label", "i", F.round("tau", 4).alias("tau"))


def pos_encoding(spark, d):
    code = G.position_code(F.col("i"))
    rows = _trace(spark, d).select("label", "i", code.alias("c"))
    return rows.select("label", "i", *[F.round(F.get("c", F.lit(k)), 4).alias(f"c{k}") for k in (0, 31, 32, 63)])


def terminal_flags(spark, d):
    w = Window.partitionBy("label")
    return _trace(spark, d).select("label", "i", (F.col("i") == 0).alias("first"), (F.col("i") == F.max("i").over(w)).alias("last"))


def chain_breaks(spark, d):
    points = table(spark, d, "embeddings").select("label", "vec_id", *[(20 * F.get("embedding", F.lit(k)).cast("double")).alias(c) for k, c in enumerate("xyz")])
    points = points.withColumn("i", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    return G.breaks(points, "label").groupBy("label", "run").agg(F.count("*").alias("n"), F.min("i").alias("lo"))


def secondary_structure(spark, d):
    return G.secondary_structure(_trace(spark, d), "label").select("label", "i", "ss")


def ss_run_lengths(spark, d):
    runs = S.runs(secondary_structure(spark, d), "label", "i", "ss")
    return runs.groupBy("ss", (F.col("hi") - F.col("lo") + 1).cast("long").alias("length")).agg(F.count("*").alias("n"))


def ss_smoothed(spark, d):
    rows = secondary_structure(spark, d).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "ss"))), lambda s: s["ss"]), "").alias("raw"))
    return rows.select("label", "raw", G.smoothed(F.col("raw")).alias("smooth"))


def virtual_cb(spark, d):
    return G.virtual_side(_trace(spark, d), "label").select("label", "i", *[F.round(c, 4).alias(c) for c in "xyz"])


def soft_contacts(spark, d):
    edges = G.soft_contacts(_trace(spark, d), "label")
    return edges.groupBy("label", "i").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("w"))


def beta_pairs(spark, d):
    return G.beta_pairs(_trace(spark, d), "label").select("label", "i", "j", F.round("d2", 4).alias("d2"))


def _profile(spark, d):
    points = _trace(spark, d)
    return G.cut_profile(G.soft_contacts(points, "label"), "label", points.groupBy("label").agg(F.count("*").alias("n")))


def cut_profile(spark, d):
    return _profile(spark, d).select("label", "k", F.round("ncut", 5).alias("ncut"))


def best_contiguous_cut(spark, d):
    best = _profile(spark, d).where("ncut is not null").groupBy("label").agg(F.min_by(F.struct("k", "ncut"), F.struct(F.round("ncut", 9), "k")).alias("b"))
    return best.select("label", "b.k", F.round("b.ncut", 5).alias("ncut"))


def cut_score_at(spark, d):
    half = _trace(spark, d).groupBy("label").agg(F.floor(F.count("*") / 2).cast("int").alias("k"))
    return _profile(spark, d).join(half, ["label", "k"]).select("label", "k", F.round("ncut", 5).alias("ncut"))


def rg_penalty(spark, d):
    return G.spread_penalty(_trace(spark, d).withColumn("piece", F.floor(F.col("i") / 100)), "label", "piece").select("label", "piece", "n", _r("penalty", 5))


def principal_axes_cov(spark, d):
    return G.covariance(_trace(spark, d), "label").select("label", "n", *[F.round(c, 2).alias(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")])


def principal_axes(spark, d):
    found = G.principal_axes(_trace(spark, d), "label")
    return found.select("label", *[F.round(F.get("spread", F.lit(k)), 3).alias(f"s{k}") for k in range(3)])


def _neighbours(spark, d):
    """Pairs of a label and the next."""
    own = table(spark, d, "embeddings").select("label").distinct()
    return own.select(F.col("label").alias("q"), (F.col("label") + 1).alias("t")).join(own.select(F.col("label").alias("t")), "t").select("q", "t")


def score_field(spark, d):
    near = lambda a, b: X.field_value(sum((a[c] - b[c]) ** 2 for c in "xyz"), F.lit(6.0))
    return G.fields(_trace(spark, d), _neighbours(spark, d), "label", near, *"xyz").groupBy("q", "t", "value").agg(F.count("*").alias("n"))


def cosine_field(spark, d):
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, d, "embeddings").select("label", place.alias("i"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.withColumn("m", F.sqrt(X.dot(F.col("v"), F.col("v")))).withColumn("m", F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")))
    alike = lambda a, b: X.cosine_value(F.round(X.dot(a["v"], b["v"]) / (a["m"] * b["m"]), 9))
    return G.fields(rows, _neighbours(spark, d), "label", alike, "v", "m").groupBy("q", "t", "value").agg(F.count("*").alias("n"))


def _pieces(spark, d):
    return _trace(spark, d).select(X.piece_key(F.col("label"), F.floor(F.col("i") / 240), 100).alias("chain"), (F.col("i") % 240).cast("int").alias("i"), *"xyz")


def domain_parse(spark, d):
    found = D.parse(_pieces(spark, d), "chain")
    return S.runs(found, "chain", "i", "label")


def domain_by_spectrum(spark, d):
    found = D.parse(_pieces(spark, d), "chain", by_spectrum=True)
    return found.groupBy("chain").agg(F.count_distinct("label").alias("domains"))


def domain_trimmed(spark, d):
    found = D.parse(_pieces(spark, d), "chain", scale=1.0, trim=3)
    return found.groupBy("chain").agg(F.count_if(F.col("label") < 0).alias("loose"), F.count("*").alias("n"))


LADDER = tuple(round(0.02 + 0.01 * k, 2) for k in range(29))


def domain_ladder(spark, d):
    found = D.parse(_pieces(spark, d), "chain", LADDER)
    return found.groupBy("chain", "rung").agg(F.count_distinct("label").alias("domains"))


def ladder_plateaus(spark, d):
    found = D.parse(_pieces(spark, d), "chain", LADDER, packed=True)
    return D.plateaus(found.select("chain", "rung", F.md5(F.array_join("labels", ",")).alias("signature")), "chain").select("chain", "first", "last", "length")


def domain_consensus(spark, d):
    runs = D.consensus_runs(_pieces(spark, d), "chain", packed=True)
    agreeing = S.of_modal_count(runs.withColumn("k", F.size(F.array_distinct("labels"))), "chain", "k")
    voted = S.majority_label(agreeing.select("chain", F.posexplode("labels").alias("i", "label")), "chain", "i", "label")
    return voted.groupBy("chain").agg(F.count_distinct("label").alias("domains"), F.round(F.avg("stability"), 6).alias("stability"))


def domain_averaged(spark, d):
    """Domains of contacts averaged over three perturbed copies."""
    points = _pieces(spark, d)
    return S.runs(D.parse(points, "chain", edges=D.averaged_contacts(points, "chain", 3)), "chain", "i", "label")


def domain_rescored(spark, d):
    """Domains whose cuts count with their mean over three graphs and leave sheets whole."""
    return S.runs(D.parse(_pieces(spark, d), "chain", score_runs=3, veto=2), "chain", "i", "label")


def _vectors(spark, d):
    """Each residue with the embedding that its step comes from."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, d, "embeddings").select("label", place.alias("at"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.select("label", F.explode(F.sequence(21 * F.col("at"), 21 * F.col("at") + 20)).alias("i"), "v")


def learned_contacts(spark, d):
    """Soft contacts weighed by the likeness of the embeddings behind their residues."""
    edges = D.learned_contacts(G.soft_contacts(_trace(spark, d), "label"), _vectors(spark, d), "label")
    return edges.groupBy("label", "i").agg(F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("w"))


def domain_learned(spark, d):
    """Domains of contacts weighed by embeddings."""
    points = _pieces(spark, d)
    vectors = _vectors(spark, d).select(X.piece_key(F.col("label"), F.floor(F.col("i") / 240), 100).alias("chain"), (F.col("i") % 240).cast("int").alias("i"), "v")
    return S.runs(D.parse(points, "chain", edges=D.learned_contacts(G.soft_contacts(points, "chain"), vectors, "chain")), "chain", "i", "label")


def trim_unstable(spark, d):
    """Runs of 150 vectors of a label whose ends are trimmed while their first component is large."""
    place = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    rows = table(spark, d, "embeddings").select(F.col("label").alias("key"), place.alias("at"), (1 - F.abs(F.get("embedding", F.lit(0)).cast("double"))).alias("stability"))
    rows = rows.withColumn("label", F.floor(F.col("at") / 150).cast("int"))
    return S.trim_unstable(rows, "key", "at", "label", "stability", 0.9, 10).groupBy("key", "label").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))


def seeded_noise(spark, d):
    """Draws and normal numbers of the seeded generator, one for each vector."""
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    seed = 40503 * F.col("label")
    return rows.select("vec_id", F.round(X.seeded_draw(seed, F.col("vec_id")), 9).alias("draw"), F.round(X.seeded_normal(seed, F.col("vec_id")), 6).alias("normal"))


QUERIES = {f.__name__: f for f in (
    domain_averaged, domain_rescored, learned_contacts, domain_learned, trim_unstable, seeded_noise,
    trace_contacts, contact_degree_norm, torsion_tau, pos_encoding, terminal_flags, chain_breaks, secondary_structure, ss_run_lengths, ss_smoothed, virtual_cb,
    soft_contacts, beta_pairs, cut_profile, best_contiguous_cut, cut_score_at, rg_penalty, principal_axes_cov, principal_axes, score_field, cosine_field, domain_parse, domain_by_spectrum, domain_trimmed, domain_ladder,
    ladder_plateaus, domain_consensus,
)}

_D2 = "(a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2"
_CONTACTS = f"{TRACE_SQL}, contacts AS (SELECT a.label, a.i, b.i AS j, {_D2} AS d2 FROM trace AS a JOIN trace AS b ON a.label = b.label WHERE {_D2} <= 100)"
_SS_WINDOW = "WINDOW w AS (PARTITION BY label ORDER BY i)"


def _gap(a: int, b: int) -> str:
    at = lambda c, k: c if k == 0 else f"lead({c}, {k}) OVER w" if k > 0 else f"lag({c}, {-k}) OVER w"
    return "sqrt(" + " + ".join(f"({at(c, a)} - {at(c, b)}) ** 2" for c in "xyz") + ")"


def _like(ideal: tuple, within: float) -> str:
    return " AND ".join(f"abs(g{k} - {v}) < {within}" for k, v in enumerate(ideal))


_SS = f"""{TRACE_SQL},
gaps AS (SELECT label, i, {', '.join(f'{_gap(a, b)} AS g{k}' for k, (a, b) in enumerate(((-2, 0), (-2, 1), (-2, 2), (-1, 1), (-1, 2), (0, 2))))} FROM trace {_SS_WINDOW}),
ss AS (SELECT label, i, CASE WHEN g2 IS NULL THEN 'C' WHEN {_like(G.HELIX, G.HELIX_WITHIN)} THEN 'H' WHEN {_like(G.STRAND, G.STRAND_WITHIN)} THEN 'E' WHEN g2 < {G.TURN} THEN 'T' ELSE 'C' END AS ss FROM gaps)"""
_SOFT = f"""{TRACE_SQL}, near AS (SELECT a.label, a.i, b.i AS j, sqrt({_D2}) AS dist FROM trace AS a JOIN trace AS b ON a.label = b.label WHERE a.i <> b.i),
edges AS (SELECT label, i, j, CASE WHEN abs(i - j) = 1 THEN 2.0 WHEN dist <= 7 THEN 1.0 ELSE (1 + cos(pi() * (dist - 7) / 2)) / 2 END AS w FROM near WHERE abs(i - j) = 1 OR dist < 9)"""
_PROFILE = f"""{_SOFT}, node AS (SELECT label, i, sum(w) AS deg, sum(CASE WHEN j < i THEN -w ELSE w END) AS step FROM edges GROUP BY label, i),
sums AS (SELECT label, i + 1 AS k, count(*) OVER (PARTITION BY label) AS n, sum(deg) OVER (PARTITION BY label) AS total, sum(deg) OVER u AS a, sum(step) OVER u AS cut
  FROM node WINDOW u AS (PARTITION BY label ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
prof AS (SELECT label, k, n, CASE WHEN k >= 40 AND n - k >= 40 THEN cut / a + cut / (total - a) END AS ncut FROM sums WHERE k < n)"""
_TAU = f"""{TRACE_SQL},
p AS (SELECT label, i, {', '.join(f'{c} - lag({c}) OVER w AS a{c}, lead({c}) OVER w - {c} AS g{c}, lead({c}, 2) OVER w - lead({c}) OVER w AS c{c}' for c in 'xyz')} FROM trace {_SS_WINDOW}),
n AS (SELECT label, i, ay * gz - az * gy AS ux, az * gx - ax * gz AS uy, ax * gy - ay * gx AS uz, gy * cz - gz * cy AS vx, gz * cx - gx * cz AS vy, gx * cy - gy * cx AS vz,
  gx, gy, gz, greatest(sqrt(gx * gx + gy * gy + gz * gz), 1e-12) AS m FROM p),
t AS (SELECT label, i, atan2(((uy * vz - uz * vy) * gx + (uz * vx - ux * vz) * gy + (ux * vy - uy * vx) * gz) / m, ux * vx + uy * vy + uz * vz) / pi() AS tau FROM n)"""

ORACLE = {
    "trace_contacts": f"WITH {_CONTACTS} SELECT label, count(*) AS n, count(*) FILTER (WHERE j - i >= 4) AS far FROM contacts GROUP BY label",
    "contact_degree_norm": f"WITH {_CONTACTS}, g AS (SELECT label, i, count(*) AS degree FROM contacts GROUP BY label, i) SELECT label, i, degree, round(CAST(degree AS DOUBLE) / max(degree) OVER (PARTITION BY label), 6) AS share FROM g",
    "torsion_tau": f"WITH {_TAU} SELECT label, i, round(coalesce(tau, 0.0), 4) AS tau FROM t",
    "pos_encoding": f"WITH {TRACE_SQL} SELECT label, i, round(sin(i + 1), 4) + 0.0 AS c0, round(sin((i + 1) * pow(2000.0, -62.0 / 64)), 4) + 0.0 AS c31, round(cos(i + 1), 4) + 0.0 AS c32, round(cos((i + 1) * pow(2000.0, -62.0 / 64)), 4) + 0.0 AS c63 FROM trace",
    "terminal_flags": f"WITH {TRACE_SQL} SELECT label, i, i = 0 AS first, i = max(i) OVER (PARTITION BY label) AS last FROM trace",
    "chain_breaks": """WITH p AS (SELECT label, vec_id, 20 * CAST(embedding[1] AS DOUBLE) AS x, 20 * CAST(embedding[2] AS DOUBLE) AS y, 20 * CAST(embedding[3] AS DOUBLE) AS z, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS i FROM embeddings),
        q AS (SELECT label, i, CASE WHEN (x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2 > 25 THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY label ORDER BY i)),
        r AS (SELECT label, i, CAST(sum(new) OVER (PARTITION BY label ORDER BY i) AS BIGINT) AS run FROM q) SELECT label, run, count(*) AS n, min(i) AS lo FROM r GROUP BY label, run""",
    "secondary_structure": f"WITH {_SS} SELECT label, i, ss FROM ss",
    "ss_run_lengths": f"""WITH {_SS}, g AS (SELECT label, i, ss, i - row_number() OVER (PARTITION BY label, ss ORDER BY i) AS island FROM ss), r AS (SELECT label, ss, island, count(*) AS length FROM g GROUP BY label, ss, island)
        SELECT ss, length, count(*) AS n FROM r GROUP BY ss, length""",
    "virtual_cb": f"""WITH {TRACE_SQL}, v AS (SELECT label, i, x, y, z, {', '.join(f'coalesce({c} - lag({c}) OVER w, 0) + coalesce({c} - lead({c}) OVER w, 0) AS v{c}' for c in 'xyz')} FROM trace {_SS_WINDOW}),
        m AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS m FROM v)
        SELECT label, i, {', '.join(f"round({c} + 3.5 * CASE WHEN m < 1e-6 THEN {1.0 if c == 'z' else 0.0} ELSE v{c} / m END, 4) AS {c}" for c in 'xyz')} FROM m""",
    "soft_contacts": f"WITH {_SOFT} SELECT label, i, count(*) AS n, round(sum(w), 4) AS w FROM edges WHERE w > 0 GROUP BY label, i",
    "learned_contacts": f"""WITH {_SOFT}, v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS at, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        e AS (SELECT e.label, e.i, e.j, CASE WHEN abs(e.i - e.j) = 1 THEN w ELSE w * pow((1 + list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))) / 2, 6) END AS w
          FROM edges AS e JOIN v AS a ON a.label = e.label AND a.at = e.i // 21 JOIN v AS b ON b.label = e.label AND b.at = e.j // 21 WHERE w > 0)
        SELECT label, i, count(*) AS n, round(sum(w), 4) AS w FROM e GROUP BY label, i""",
    "trim_unstable": """WITH p AS (SELECT label AS key, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS spot, 1 - abs(CAST(embedding[1] AS DOUBLE)) >= 0.9 AS sure FROM embeddings),
        q AS (SELECT key, spot, spot // 150 AS label, row_number() OVER (PARTITION BY key, spot // 150 ORDER BY spot) AS k, sure FROM p),
        r AS (SELECT key, label, count(*) AS n, min(k) FILTER (WHERE sure) AS first, max(k) FILTER (WHERE sure) AS last FROM q GROUP BY key, label),
        s AS (SELECT *, CASE WHEN n >= 10 THEN greatest(0, n - greatest(10, CAST(ceil(n * 0.45) AS INTEGER))) ELSE 0 END AS spare FROM r),
        t AS (SELECT key, label, n, spare, least(coalesce(first - 1, n), spare) AS front, last FROM s),
        u AS (SELECT q.key, q.spot, CASE WHEN k > front AND k <= n - least(coalesce(n - last, n), spare - front) THEN q.label END AS label FROM q JOIN t ON q.key = t.key AND q.label = t.label)
        SELECT key, CAST(label AS INTEGER) AS label, count(*) AS n, min(spot) AS lo, max(spot) AS hi FROM u GROUP BY key, label""",
    "seeded_noise": f"""WITH d AS (SELECT vec_id, unnest([0, 1, 2]) AS which, label FROM embeddings),
        a AS (SELECT vec_id, which, CAST((40503 * CAST(label AS HUGEINT) + ((CASE which WHEN 0 THEN vec_id ELSE vec_id - vec_id % 2 + which - 1 END) + 1) * CAST(2654435769 AS HUGEINT)) & 4294967295 AS HUGEINT) AS t FROM d),
        b AS (SELECT vec_id, which, (xor(t, t >> 15) * (t | 1)) & 4294967295 AS t FROM a),
        c AS (SELECT vec_id, which, xor(t, (t + ((xor(t, t >> 7) * (t | 61)) & 4294967295)) & 4294967295) AS t FROM b),
        u AS (SELECT vec_id, which, CAST(xor(t, t >> 14) AS DOUBLE) / 4294967296.0::DOUBLE AS u FROM c),
        p AS (SELECT vec_id, max(u) FILTER (WHERE which = 0) AS draw, max(u) FILTER (WHERE which = 1) AS u, max(u) FILTER (WHERE which = 2) AS v FROM u GROUP BY vec_id)
        SELECT vec_id, round(draw, 9) AS draw, round(sqrt(-2 * ln(greatest(u, 1e-12))) * CASE vec_id % 2 WHEN 0 THEN cos(2 * pi() * v) ELSE sin(2 * pi() * v) END, 6) AS normal FROM p""",
    "beta_pairs": f"WITH {TRACE_SQL} SELECT a.label, a.i, b.i AS j, round({_D2}, 4) AS d2 FROM trace AS a JOIN trace AS b ON a.label = b.label WHERE b.i - a.i >= 5 AND {_D2} <= 30.25",
    "cut_profile": f"WITH {_PROFILE} SELECT label, k, round(ncut, 5) AS ncut FROM prof",
    "best_contiguous_cut": f"WITH {_PROFILE}, r AS (SELECT label, k, ncut, row_number() OVER (PARTITION BY label ORDER BY round(ncut, 9), k) AS r FROM prof WHERE ncut IS NOT NULL) SELECT label, k, round(ncut, 5) AS ncut FROM r WHERE r = 1",
    "cut_score_at": f"WITH {_PROFILE} SELECT label, k, round(ncut, 5) AS ncut FROM prof WHERE k = n // 2",
    "rg_penalty": f"""WITH {TRACE_SQL}, g AS (SELECT label, CAST(floor(i / 100) AS BIGINT) AS piece, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, avg(x * x + y * y + z * z) AS sq FROM trace GROUP BY 1, 2)
        SELECT label, piece, n, round(greatest(1.0, sqrt(greatest(0, sq - mx * mx - my * my - mz * mz)) / (2.2 * pow(n, 0.38))), 5) AS penalty FROM g""",
    "principal_axes_cov": f"WITH {TRACE_SQL} SELECT label, count(*) AS n, {', '.join(f'round(sum({a} * {b}) - sum({a}) * sum({b}) / count(*), 2) AS {a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM trace GROUP BY label",
    "score_field": f"""WITH {TRACE_SQL}, sized AS (SELECT label, count(*) AS n FROM trace GROUP BY label),
        p AS (SELECT a.label AS q, b.label AS t, greatest(1, CAST(ceil(sqrt(CAST(a.n AS DOUBLE) * b.n / 480000)) AS INTEGER)) AS stride FROM sized AS a JOIN sized AS b ON b.label = a.label + 1),
        f AS (SELECT q, t, CAST(floor(255 / (1 + ({_D2}) / 36.0) + 0.5) AS INTEGER) AS value FROM p JOIN trace AS a ON a.label = q AND a.i % stride = 0 JOIN trace AS b ON b.label = t AND b.i % stride = 0) SELECT q, t, value, count(*) AS n FROM f GROUP BY q, t, value""",
    "cosine_field": """WITH r AS (SELECT label, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        m AS (SELECT *, coalesce(nullif(sqrt(list_dot_product(v, v)), 0), 1) AS m FROM r), sized AS (SELECT label, count(*) AS n FROM r GROUP BY label),
        p AS (SELECT a.label AS q, b.label AS t, greatest(1, CAST(ceil(sqrt(CAST(a.n AS DOUBLE) * b.n / 480000)) AS INTEGER)) AS stride FROM sized AS a JOIN sized AS b ON b.label = a.label + 1),
        c AS (SELECT q, t, round(list_dot_product(a.v, b.v) / (a.m * b.m), 9) AS cosine FROM p JOIN m AS a ON a.label = q AND a.i % stride = 0 JOIN m AS b ON b.label = t AND b.i % stride = 0),
        f AS (SELECT q, t, CAST(CASE WHEN cosine <= 0 THEN 0 ELSE least(255, floor(cosine * 255 + 0.5)) END AS INTEGER) AS value FROM c) SELECT q, t, value, count(*) AS n FROM f GROUP BY q, t, value""",
}
