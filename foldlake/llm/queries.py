"""One query for each operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fill_middle, importance, language_id, language_model, licenses, mixing, quality, secrets, topk, toxicity
from .line_dedup import line_dedup
from .near_duplicates import near_duplicates
from .shared import checkpointed, crc_mod, table

#: Of the ids, every HELD_OUT-th by crc32 is never learned from.
HELD_OUT = 5


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth vector, by integer inner product."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = """
WITH good AS (
  SELECT row_number() OVER () AS r, vec_id, len(embedding) AS n, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
parts AS (SELECT r, vec_id, n, unnest(v) AS x, unnest(generate_series(1, n)) AS i FROM good),
scores AS (
  SELECT q.r, q.vec_id AS query_id, d.vec_id AS vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score
  FROM parts AS q JOIN parts AS d ON q.i = d.i AND q.n = d.n
  WHERE q.vec_id % 50 = 0 AND q.r <> d.r
  GROUP BY q.r, q.vec_id, d.r, d.vec_id
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each license notice in each document, with its place and containment."""
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("licenses").alias("l")).select("doc_id", "l.template", "l.start", "l.end", "l.containment")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of each document under the backoff automaton and the unigram base, to six decimals."""
    out = language_model.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 10) == 0)
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


#: crc32 bit by bit: a byte is mixed in, and eight shifts follow it, each marked by -1.
_CRC32 = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(range(1, length(id) + 1), lambda i: [CAST(ascii(substr(id, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""

OP3_SQL = rf"""
WITH ids AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents),
docs AS (
  SELECT r, doc_id, {_CRC32} % 10 = 0 AS held_out,
         list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' end') AS w FROM ids
),
words AS (SELECT r, held_out, unnest(w) AS w, unnest(generate_series(1, len(w))) AS i FROM docs),
t AS (SELECT r, held_out, w, lag(w, 1, ' start') OVER o AS v, lag(w, 2, ' start') OVER o AS u FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
one AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
two AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY u, v, w),
sums AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v, (SELECT count(*) FILTER (WHERE NOT held_out) FROM docs) AS starts FROM one),
counted AS (
  SELECT t.r, coalesce(one.c, 0) AS c1, coalesce(two.c, 0) AS c2, coalesce(three.c, 0) AS c3,
         CASE WHEN t.v = ' start' THEN starts ELSE coalesce(h.c, 0) END AS h1, CASE WHEN t.v = ' start' THEN starts ELSE coalesce(g.c, 0) END AS h2, sums.n, sums.v
  FROM t CROSS JOIN sums LEFT JOIN one ON one.w = t.w LEFT JOIN two ON two.v = t.v AND two.w = t.w LEFT JOIN three ON three.u = t.u AND three.v = t.v AND three.w = t.w
  LEFT JOIN one AS h ON h.w = t.v LEFT JOIN two AS g ON g.v = t.u AND g.w = t.v
),
chance AS (SELECT r, c1, (c1 + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p1, c2, c3, h1, h2, 2 * pow(greatest(h1, 1), 0.9::DOUBLE) AS k1, 2 * pow(greatest(h2, 1), 0.9::DOUBLE) AS k2 FROM counted),
backed AS (SELECT r, c1, p1, (c3 + k2 * (c2 + k1 * p1) / (h1 + k1)) / (h2 + k2) AS p FROM chance),
scores AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (WHERE c1 > 0) AS n_known, round(sum(log10(p1)), 6) AS base_score, round(sum(log10(p)), 6) AS score FROM backed GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, CAST(n AS BIGINT) AS train_tokens, base_score, score FROM docs JOIN scores ON docs.r = scores.r CROSS JOIN sums
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the lines of ten or more sites removed but for their first document."""
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, i, trim(x, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, source, unnest(l) AS x, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents) AS s) AS t
),
bad AS (
  SELECT line, min(doc_id) AS first_id FROM lines WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT coalesce(source, chr(0))) >= 10
),
marked AS (
  SELECT lines.doc_id, i, bad.line IS NOT NULL AND lines.doc_id <> bad.first_id AS gone
  FROM lines LEFT JOIN bad ON lines.line = bad.line
),
kept AS (
  SELECT m.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(CASE WHEN NOT gone THEN d.l[m.i] END, chr(10) ORDER BY m.i) AS text
  FROM marked AS m JOIN (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) AS d ON m.doc_id = d.doc_id
  GROUP BY m.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents AS d LEFT JOIN kept AS k ON d.doc_id = k.doc_id
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of 150 % of all words takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    drawn = mixing.plan(checkpointed(docs), F.col("size"), F.col("mark"))
    return drawn.select("doc.doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.size("shards")).cast("long").alias("taken"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with a Jaccard similarity of 0.8 on four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM words WHERE len(w) > 0) AS t
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets AS a JOIN sets AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN sizes AS p ON p.doc_id = x JOIN sizes AS q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, edges.y FROM reach JOIN edges ON reach.y = edges.x),
component AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents AS d LEFT JOIN sizes ON d.doc_id = sizes.doc_id JOIN component ON d.doc_id = component.x
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place where a document holds a benchmark item, with its edits."""
    found = decontamination.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.start", "leak.end", "leak.edits")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: pattern spans and those that the Markov models add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.fit(secrets.labelled_samples(spark).unionByName(secrets.corpus_words(docs)))
    found = secrets.secrets(docs, model)
    base = F.filter("_spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("_spans")).alias("spans"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), HELD_OUT) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = quality.quality(docs, model, "doc_id").select("doc_id", F.col("quality_score").alias("score"))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of each document, and its offending sentences."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), HELD_OUT) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = toxicity.toxicity(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), "offending")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and the draw of a tenth of the documents of twenty words or more."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return importance.resampled(docs, table(spark, sf_dir, "benchmark"), carried=("doc_id",))


#: crc32 of the bytes of w, as above.
_CRC32_BYTES = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(range(0, octet_length(encode(w))), lambda i: [CAST(concat('0x', substr(hex(encode(w)), 2 * i + 1, 2)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""

OP11_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, text, true AS own FROM documents UNION ALL SELECT -row_number() OVER () AS r, NULL AS doc_id, text, false AS own FROM benchmark
),
words AS (SELECT r, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
counted AS (SELECT r, own, w, count(*) AS n FROM (SELECT r, own, unnest(ws) AS w FROM words) AS u GROUP BY r, own, w),
hashed AS (SELECT w, {_CRC32_BYTES} % 10000 AS b FROM (SELECT DISTINCT w FROM counted) AS d),
buckets AS (SELECT b, sum(n) FILTER (WHERE own) AS s, sum(n) FILTER (WHERE NOT own) AS t FROM counted JOIN hashed USING (w) GROUP BY b),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM buckets),
gain AS (
  SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS g FROM buckets CROSS JOIN totals
),
sums AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * g) AS BIGINT) AS total FROM counted JOIN hashed USING (w) JOIN gain USING (b) WHERE own GROUP BY r),
weighed AS (
  SELECT words.r, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
         CAST(CAST(concat('0x', substr(sha256(concat('2024:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 8)) AS BIGINT) AS DOUBLE) AS h
  FROM words LEFT JOIN sums ON words.r = sums.r WHERE own
),
scored AS (SELECT r, doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed),
ordered AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE n_features >= 20),
size AS (SELECT count(*) * 10 // 100 AS k FROM ordered)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM scored LEFT JOIN ordered ON scored.r = ordered.r CROSS JOIN size
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's rearranged form, and of the text restored from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fill_middle.fill_in_middle(docs, carried=("doc_id",))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP12_SQL = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256(concat('1:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS d FROM documents),
coins AS (
  SELECT doc_id, text, n, CAST(concat('0x', substr(d, 1, 8)) AS BIGINT) % (n + 1) AS x, CAST(concat('0x', substr(d, 9, 8)) AS BIGINT) % (n + 1) AS y,
         CAST(concat('0x', substr(d, 17, 8)) AS BIGINT) % 100 AS p, CAST(concat('0x', substr(d, 25, 8)) AS BIGINT) % 100 AS q FROM texts
),
cut AS (
  SELECT doc_id, text, n, least(x, y) AS a, greatest(x, y) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p >= 90 THEN 'plain' WHEN q < 20 THEN 'spm' ELSE 'psm' END AS form FROM coins
),
parts AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1, n - b) AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE concat(prefix, middle, suffix) END) AS restored_sha256
FROM parts
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document by rank-order profiles, learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    profile = language_id.profiles(docs, ~held_out)
    out = language_id.identified(docs, profile, carried=("doc_id",))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.round("score", 9).alias("score"))


OP13_SQL = rf"""
WITH ids AS (SELECT row_number() OVER () AS r, doc_id, text, lang, coalesce(CAST(doc_id AS VARCHAR), '') AS id FROM documents),
docs AS (SELECT r, doc_id, lang, {_CRC32} % 3 = 1 AS held_out, coalesce(regexp_matches(text, '\p{{L}}'), false) AS lettered, string_split(concat(' ', regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{M}}]+', ' ', 'g'), ' '), '') AS c FROM ids),
points AS (SELECT r, unnest(c) AS x, unnest(generate_series(1, len(c))) AS i FROM docs),
runs AS (SELECT r, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM points WINDOW o AS (PARTITION BY r ORDER BY i)),
grams AS (
  SELECT r, x AS g FROM runs WHERE x <> ' ' UNION ALL SELECT r, x || y FROM runs WHERE y IS NOT NULL AND NOT (x = ' ' AND y = ' ')
  UNION ALL SELECT r, x || y || z FROM runs WHERE z IS NOT NULL AND y <> ' '
),
own AS (SELECT r, g, count(*) AS n FROM grams GROUP BY r, g),
documented AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, g) - 1 AS place FROM own QUALIFY place < 400),
learned AS (SELECT lang, g, sum(n) AS n FROM own JOIN docs USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g),
profile AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS place FROM learned QUALIFY place < 400),
lengths AS (SELECT r, count(*) AS n FROM documented GROUP BY r),
saved AS (SELECT d.r, p.lang, sum(400 - abs(d.place - p.place)) AS s FROM documented AS d JOIN profile AS p ON d.g = p.g GROUP BY d.r, p.lang),
langs AS (SELECT DISTINCT lang FROM profile),
best AS (
  SELECT l.r, langs.lang, 400 * l.n - coalesce(s, 0) AS distance, l.n FROM lengths AS l CROSS JOIN langs LEFT JOIN saved ON saved.r = l.r AND saved.lang = langs.lang
  QUALIFY row_number() OVER (PARTITION BY l.r ORDER BY 400 * l.n - coalesce(s, 0), langs.lang) = 1
)
SELECT doc_id, held_out, CASE WHEN lettered AND best.lang IS NOT NULL THEN best.lang ELSE 'und' END AS lang_pred,
       CASE WHEN lettered AND best.lang IS NOT NULL THEN round(1 - CAST(distance AS DOUBLE) / (400 * n), 9) ELSE 0.0 END AS score
FROM docs LEFT JOIN best USING (r)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_license_scan": op2_license_scan,
    "op3_language_model": op3_language_model,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_language_id": op13_language_id,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {"op1_top_k": OP1_SQL, "op3_language_model": OP3_SQL, "op4_line_dedup": OP4_SQL, "op6_near_duplicates": OP6_SQL, "op11_importance_resampling": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_language_id": OP13_SQL}
