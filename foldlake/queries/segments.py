"""Queries over runs, intervals, votes and row metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import meta as M
from ..operators import segments as S
from ..plans.views import SEGMENT_SQL, event_segments, table


def _seg(spark, d):
    return event_segments(table(spark, d, "events"))


def label_segments(spark, d):
    return _seg(spark, d).select("user_id", "event_type", "lo", "hi")


def run_islands(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "event_type", (F.row_number().over(w) - 1).alias("i"))
    return S.runs(rows, "user_id", "i", "event_type")


def segment_residues(spark, d):
    return S.residues(_seg(spark, d).where("event_type = 'click'"), "user_id", "event_type").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("i").cast("long").alias("total"))


def segment_merge(spark, d):
    kinds = F.col("event_type").isin("click", "view", "purchase")
    return S.merged(_seg(spark, d).where(kinds).select("user_id", "lo", "hi"), "user_id")


def largest_gap(spark, d):
    seg = _seg(spark, d)
    n = seg.groupBy("user_id").agg((F.max("hi") + 1).alias("n"))
    return S.largest_gap(seg.where("event_type <> 'click'"), n, "user_id")


def segment_clean(spark, d):
    return S.clean(_seg(spark, d), "user_id", "event_type", 2).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("hi") - F.col("lo") + 1).cast("long").alias("places"))


def segment_signature(spark, d):
    own = _seg(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("s"))
    return own.select("user_id", S.signature(F.col("s")).alias("signature"))


def chopping_nres(spark, d):
    return _seg(spark, d).groupBy("user_id", "event_type").agg(F.sum(F.col("hi") - F.col("lo") + 1).cast("long").alias("nres"))


def bin_owner(spark, d):
    bins = spark.range(64).select(F.col("id").cast("int").alias("bin"))
    seg = _seg(spark, d)
    n = seg.groupBy("user_id").agg((F.max("hi") + 1).alias("n"))
    mids = n.join(F.broadcast(bins)).withColumn("mid", F.floor((F.col("bin") + 0.5) * F.col("n") / 64).cast("int"))
    hit = mids.alias("m").join(seg.alias("s"), (F.col("m.user_id") == F.col("s.user_id")) & F.col("m.mid").between(F.col("s.lo"), F.col("s.hi")))
    return hit.groupBy("m.bin", "s.event_type").agg(F.count("*").alias("n"))


def _votes(spark, d, lines=None, *more):
    """Synthetic runs: five labellings of each order's lines, with the columns ``more``."""
    lines = table(spark, d, "lineitem") if lines is None else lines
    runs = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("run")
    label = F.when((F.col("l_partkey") + F.col("run")) % 7 == 0, F.lit(None)).otherwise(F.floor((F.col("l_partkey") + F.col("run") * F.col("l_suppkey")) % 11 / 4)).cast("int")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *more, runs).select("l_orderkey", F.col("l_linenumber").alias("i"), "run", label.alias("label"), *more)


def modal_vote(spark, d):
    counts = _votes(spark, d).groupBy("l_orderkey", "run").agg(F.count_distinct("label").alias("k"))
    return S.modal_count(counts, "l_orderkey", "k")


def majority_label(spark, d):
    return S.majority_label(_votes(spark, d), "l_orderkey", "i", "label").select("l_orderkey", "i", "label")


def stability(spark, d):
    return S.majority_label(_votes(spark, d), "l_orderkey", "i", "label").groupBy("l_orderkey").agg(F.round(F.avg("stability"), 6).alias("stability"))


def coassociation(spark, d):
    # lines are dealt by their order once, before they are copied for each run
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumn("n", F.max("l_linenumber").over(Window.partitionBy("l_orderkey")))
    votes = _votes(spark, d, lines, "n").withColumn("i", F.col("i") - 1)
    return S.coassociation(votes, "l_orderkey", "run", "i", "label", 4, F.col("n"))


def prefix_offsets(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    return M.prefix_offsets(parts, "p_partkey", "p_size").select("p_partkey", "offset")


def block_base(spark, d):
    offsets = M.prefix_offsets(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", "p_size")
    return offsets.groupBy(F.floor(F.col("p_partkey") / 256).alias("block")).agg(F.min("offset").alias("base"), F.count("*").alias("n"))


def _shards(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("shard_id"), (F.col("s_suppkey") * 17 + 5).alias("row0"))


def shard_locate(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row"))
    return M.locate(rows, _shards(spark, d)).select("row", F.col("shard.shard_id").alias("shard_id"), (F.col("row") - F.col("shard.row0")).alias("local_row"))


def asof_shard(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"))
    found = M.locate(rows, _shards(spark, d)).select("row", F.col("shard.shard_id").alias("shard_id"))
    return found.groupBy("shard_id").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last"))


def class_lookup(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("path"))
    paths = table(spark, d, "nation").select(F.col("n_nationkey").alias("path"), F.col("n_name").alias("code"), F.col("n_regionkey").alias("name_id"))
    names = table(spark, d, "region").select(F.col("r_regionkey").alias("name_id"), F.col("r_name").alias("name"))
    return M.classify(rows, paths, names).select("s_suppkey", "code", "name")


def class_fold_rollup(spark, d):
    rows = class_lookup(spark, d)
    return rows.rollup("name", "code").agg(F.count("*").alias("n")).select(F.coalesce("name", F.lit("*")).alias("name"), F.coalesce("code", F.lit("*")).alias("code"), "n")


def _accession(key):
    # the six lowest digits: padding would keep the first six of more
    return F.lpad(F.upper(F.conv(F.pmod(key * 7919 + 11, F.lit(36**6)).cast("string"), 10, 36)), 6, "0")


def id_pack_unpack(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", _accession(F.col("c_custkey")).alias("acc"), F.pmod(F.col("c_custkey"), F.lit(13)).alias("k"))
    packed = rows.withColumn("packed", X.pack_id(F.col("acc"), F.col("k")))
    return packed.select("c_custkey", X.unpack_accession(F.col("packed")).alias("accession"), X.unpack_index(F.col("packed")).alias("part"))


def id_display(spark, d):
    n = F.col("n_nationkey")
    name = F.when(n % 3 == 0, F.concat(F.lit("AF-P"), F.lpad(n.cast("string"), 5, "0"), F.lit("-F1-model_v4_TED0"), (n % 4).cast("string"))).when(n % 3 == 1, F.concat(F.lit("d1ab"), (n % 10).cast("string"), F.lit("a_"))).otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", X.display_id(name).alias("shown"))


def id_path(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.cluster_path(F.col("c_custkey") * 29).alias("path"))


def format_guess(spark, d):
    return table(spark, d, "documents").select("doc_id", X.guess_format(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("data_x\n"), "text")).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\n_atom_site.id"))).otherwise(F.col("text"))).alias("format"))


def sha_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("digest"))


def distance_scales(spark, d):
    n = F.col("p_size") * 7
    return table(spark, d, "part").select("p_partkey", *[F.round(f(n), 6).alias(a) for f, a in ((X.search_scale, "search"), (X.final_scale, "final"), (X.score_cutoff, "cutoff"))])


def aligned_rank(spark, d):
    w = Window.partitionBy("l_orderkey")
    rows = table(spark, d, "lineitem").withColumn("r", F.dense_rank().over(w.orderBy("l_partkey")) - 1)
    top = F.max("r").over(w)
    return rows.select("l_orderkey", "l_linenumber", F.round(F.when(top == 0, 0.0).otherwise(F.col("r") / top), 6).alias("rank"))


def path_breaks(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 9).alias("q"), (F.col("l_suppkey") % 9).alias("t"))
    jump = (F.abs(F.col("q") - F.lag("q").over(w)) > 3) | (F.abs(F.col("t") - F.lag("t").over(w)) > 3)
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(jump, F.lit(False)).alias("broken"))


def cp_window_cut(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").isin("click", "view").alias("on"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    return S.window_densest(rows, "user_id", "i", "on")


def permute_chain(spark, d):
    w = Window.partitionBy("user_id")
    rows = table(spark, d, "events").withColumn("i", F.row_number().over(w.orderBy("event_id")) - 1).withColumn("n", F.count("*").over(w))
    return rows.select("user_id", "event_id", ((F.col("i") + 3) % F.col("n")).alias("at"))


def greedy_shards(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("s"))
    return M.greedy_shards(rows, "p_partkey", "s", _SHARD).groupBy("shard").agg(F.count("*").alias("n"), F.sum("s").cast("long").alias("used"))


QUERIES = {f.__name__: f for f in (
    label_segments, run_islands, segment_residues, segment_merge, largest_gap, segment_clean, segment_signature, chopping_nres, bin_owner, modal_vote,
    majority_label, stability, coassociation, prefix_offsets, block_base, shard_locate, asof_shard, class_lookup, class_fold_rollup, id_pack_unpack,
    id_display, id_path, format_guess, sha_prefix, distance_scales, aligned_rank, path_breaks, cp_window_cut, permute_chain, greedy_shards,
)}

_SHARD = 500
_VOTES = """
votes AS (
  SELECT l_orderkey, l_linenumber AS i, run, CASE WHEN (l_partkey + run) % 7 = 0 THEN NULL ELSE CAST(floor(((l_partkey + run * l_suppkey) % 11) / 4.0) AS INTEGER) END AS label
  FROM lineitem, range(0, 5) AS t(run)
)"""
_MAJORITY = f"""{_VOTES},
tally AS (SELECT l_orderkey, i, label, count(*) AS n FROM votes GROUP BY l_orderkey, i, label),
best AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, i ORDER BY n DESC, coalesce(label, 1000000)) AS r, sum(n) OVER (PARTITION BY l_orderkey, i) AS runs FROM tally)"""
_OFFSETS = "offs AS (SELECT p_partkey, CAST(coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM part)"
_SHARDS = "shards AS (SELECT s_suppkey AS shard_id, s_suppkey * 17 + 5 AS row0, lead(s_suppkey * 17 + 5) OVER (ORDER BY s_suppkey) AS row1 FROM supplier)"
_CLASS = "cls AS (SELECT s_suppkey, n_name AS code, r_name AS name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"
_B36 = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_ACC = " || ".join(f"substr({_B36}, CAST(((c_custkey * 7919 + 11) // {36**k}) % 36 AS INTEGER) + 1, 1)" for k in range(5, -1, -1))

ORACLE = {
    "label_segments": f"WITH {SEGMENT_SQL} SELECT * FROM seg",
    "run_islands": f"WITH {SEGMENT_SQL} SELECT * FROM seg",
    "segment_residues": f"WITH {SEGMENT_SQL} SELECT user_id, CAST(sum(hi - lo + 1) AS BIGINT) AS n, CAST(sum((lo + hi) * (hi - lo + 1) // 2) AS BIGINT) AS total FROM seg WHERE event_type = 'click' GROUP BY user_id",
    "segment_merge": f"""WITH {SEGMENT_SQL}, k AS (SELECT user_id, lo, hi FROM seg WHERE event_type IN ('click', 'view', 'purchase')),
        m AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY user_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM k),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY lo) AS run FROM m) SELECT user_id, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY user_id, run""",
    "largest_gap": f"""WITH {SEGMENT_SQL}, n AS (SELECT user_id, max(hi) + 1 AS n FROM seg GROUP BY user_id),
        free AS (SELECT user_id, lo, hi FROM seg WHERE event_type = 'click'),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hi - lo DESC, lo) AS r FROM free)
        SELECT n.user_id, CAST(CASE WHEN r.hi - r.lo + 1 >= 4 THEN r.lo ELSE floor(n.n * 0.4) END AS INTEGER) AS lo, CAST(CASE WHEN r.hi - r.lo + 1 >= 4 THEN r.hi ELSE floor(n.n * 0.6) END AS INTEGER) AS hi
        FROM n LEFT JOIN (SELECT * FROM r WHERE r = 1) AS r ON n.user_id = r.user_id""",
    "segment_clean": f"WITH {SEGMENT_SQL} SELECT event_type, count(*) AS n, CAST(sum(hi - lo + 1) AS BIGINT) AS places FROM seg WHERE hi - lo + 1 >= 2 GROUP BY event_type",
    "segment_signature": f"WITH {SEGMENT_SQL} SELECT user_id, string_agg(lo || '-' || hi, '+' ORDER BY lo) AS signature FROM seg GROUP BY user_id",
    "chopping_nres": f"WITH {SEGMENT_SQL} SELECT user_id, event_type, CAST(sum(hi - lo + 1) AS BIGINT) AS nres FROM seg GROUP BY user_id, event_type",
    "bin_owner": f"""WITH {SEGMENT_SQL}, n AS (SELECT user_id, max(hi) + 1 AS n FROM seg GROUP BY user_id),
        m AS (SELECT user_id, CAST(bin AS INTEGER) AS bin, CAST(floor((bin + 0.5) * n / 64) AS INTEGER) AS mid FROM n, range(0, 64) AS t(bin))
        SELECT bin, event_type, count(*) AS n FROM m JOIN seg ON m.user_id = seg.user_id AND mid BETWEEN lo AND hi GROUP BY bin, event_type""",
    "modal_vote": f"""WITH {_VOTES}, c AS (SELECT l_orderkey, run, count(DISTINCT label) AS k FROM votes GROUP BY l_orderkey, run), t AS (SELECT l_orderkey, k, count(*) AS n FROM c GROUP BY l_orderkey, k),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, k) AS r, sum(n) OVER (PARTITION BY l_orderkey) AS runs FROM t) SELECT l_orderkey, k AS modal, n AS n_votes, CAST(runs AS BIGINT) AS n_runs FROM r WHERE r = 1""",
    "majority_label": f"WITH {_MAJORITY} SELECT l_orderkey, i, label FROM best WHERE r = 1",
    "stability": f"WITH {_MAJORITY} SELECT l_orderkey, round(avg(CAST(n AS DOUBLE) / runs), 6) AS stability FROM best WHERE r = 1 GROUP BY l_orderkey",
    "coassociation": f"""WITH {_VOTES}, v AS (SELECT l_orderkey, run, i - 1 AS i, label, max(i) OVER (PARTITION BY l_orderkey) AS n FROM votes),
        b AS (SELECT l_orderkey, run, CAST(bin AS INTEGER) AS bin, label FROM v, range(0, 4) AS t(bin) WHERE bin < least(4, n) AND i = floor((bin + 0.5) * n / least(4, n)) AND label IS NOT NULL)
        SELECT p.l_orderkey, p.bin AS a, q.bin AS b, count(*) AS votes FROM b AS p JOIN b AS q ON p.l_orderkey = q.l_orderkey AND p.run = q.run AND p.label = q.label GROUP BY 1, 2, 3""",
    "prefix_offsets": f"WITH {_OFFSETS} SELECT p_partkey, base AS offset FROM offs",
    "block_base": f"WITH {_OFFSETS} SELECT p_partkey // 256 AS block, min(base) AS base, count(*) AS n FROM offs GROUP BY 1",
    "shard_locate": f"WITH {_SHARDS} SELECT p_partkey AS row, shard_id, p_partkey - row0 AS local_row FROM part LEFT JOIN shards ON p_partkey >= row0 AND (row1 IS NULL OR p_partkey < row1)",
    "asof_shard": f"WITH {_SHARDS} SELECT shard_id, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders LEFT JOIN shards ON o_orderkey >= row0 AND (row1 IS NULL OR o_orderkey < row1) GROUP BY shard_id",
    "class_lookup": f"WITH {_CLASS} SELECT s_suppkey, code, name FROM cls",
    "class_fold_rollup": f"WITH {_CLASS} SELECT coalesce(name, '*') AS name, coalesce(code, '*') AS code, count(*) AS n FROM cls GROUP BY ROLLUP (name, code)",
    "id_pack_unpack": f"SELECT c_custkey, {_ACC} AS accession, CAST(c_custkey % 13 AS INTEGER) AS part FROM customer",
    "id_display": """SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'P' || lpad(CAST(n_nationkey AS VARCHAR), 5, '0') || '/0' || CAST(n_nationkey % 4 AS VARCHAR)
        WHEN n_nationkey % 3 = 1 THEN '1AB' || CAST(n_nationkey % 10 AS VARCHAR) || '_A' ELSE n_name END AS shown FROM nation""",
    "id_path": "SELECT c_custkey, lpad(lower(to_hex((c_custkey * 29) // 256)), 2, '0') || '/' || CAST(c_custkey * 29 AS VARCHAR) AS path FROM customer WHERE true",
    "format_guess": "SELECT doc_id, CASE WHEN doc_id % 3 = 2 AND position('_atom_site.' IN text) = 0 AND NOT regexp_matches(text, '(?m)^\\s*data_') THEN 'pdb' ELSE 'mmcif' END AS format FROM documents",
    "sha_prefix": "SELECT doc_id, substr(sha256(text), 1, 16) AS digest FROM documents",
    "distance_scales": """SELECT p_partkey, round((CASE WHEN p_size * 7 <= 19 THEN 0.168 ELSE 1.24 * cbrt(p_size * 7 - 15) - 1.8 END) + 0.8, 6) AS search,
        round(greatest(0.5, CASE WHEN p_size * 7 <= 21 THEN 0.5 ELSE 1.24 * cbrt(p_size * 7 - 15) - 1.8 END), 6) AS final, round(1.5 * pow(p_size * 7, 0.3) + 3.5, 6) AS cutoff FROM part""",
    "aligned_rank": """WITH r AS (SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS r FROM lineitem), m AS (SELECT *, max(r) OVER (PARTITION BY l_orderkey) AS top FROM r)
        SELECT l_orderkey, l_linenumber, round(CASE WHEN top = 0 THEN 0.0 ELSE CAST(r AS DOUBLE) / top END, 6) AS rank FROM m""",
    "path_breaks": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 9 AS q, l_suppkey % 9 AS t FROM lineitem)
        SELECT l_orderkey, l_linenumber, coalesce(abs(q - lag(q) OVER w) > 3 OR abs(t - lag(t) OVER w) > 3, false) AS broken FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)""",
    "cp_window_cut": """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS f FROM events),
        t AS (SELECT user_id, i + c * n AS p, n, f FROM r, range(0, 2) AS k(c)), s AS (SELECT user_id, p, n, sum(f) OVER (PARTITION BY user_id ORDER BY p) AS s FROM t),
        w AS (SELECT a.user_id, a.p - a.n + 1 AS cut, a.s - coalesce(b.s, 0) AS held FROM s AS a LEFT JOIN s AS b ON a.user_id = b.user_id AND b.p = a.p - a.n WHERE a.p - a.n + 1 BETWEEN 0 AND a.n - 2),
        o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY held DESC, cut) AS r FROM w) SELECT user_id, cut, CAST(held AS BIGINT) AS n_in FROM o WHERE r = 1""",
    "permute_chain": "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + 3) % count(*) OVER (PARTITION BY user_id) AS at FROM events",
    "greedy_shards": f"""WITH RECURSIVE p AS (SELECT p_size AS s, row_number() OVER (ORDER BY p_partkey) AS i FROM part),
        walk AS (SELECT i, s, CAST(0 AS BIGINT) AS shard, CAST(s AS BIGINT) AS used FROM p WHERE i = 1
          UNION ALL SELECT p.i, p.s, CASE WHEN walk.used > 0 AND walk.used + p.s > {_SHARD} THEN walk.shard + 1 ELSE walk.shard END, CASE WHEN walk.used > 0 AND walk.used + p.s > {_SHARD} THEN p.s ELSE walk.used + p.s END
          FROM walk JOIN p ON p.i = walk.i + 1)
        SELECT shard, count(*) AS n, CAST(sum(s) AS BIGINT) AS used FROM walk GROUP BY shard""",
}
