"""Secrets in texts: fixed patterns, and character Markov models of what a key looks like.

Patterns give three kinds of span.  Beyond these, tokens of 16 or more key characters are
scored whole by two first-order character Markov models, one of random strings and one of
ordinary identifiers and of the words of a sample of the documents; a token whose mean log-likelihood ratio exceeds ``RATIO`` a character is
a span of kind "markov", unless it overlaps a pattern's span.

Everything is DataFrame functions.  The position of a match comes from the lengths of the
pieces that ``split`` leaves between the matches of ``regexp_extract_all``.  The models are
counted by Spark from labelled samples; what reaches the driver is one number for each pair
of the 66 symbols, whatever the samples' size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fields, whole

# The patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 12, 18, 16
# The same matches, of sufficient length only: a run that is too short holds no later match that is long enough.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

RATIO, SMOOTH = 0.7, 0.5
#: Documents and bytes of each that ordinary words are learned from.
SAMPLE, SAMPLE_BYTES = 2000, 1 << 16
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="

# Parts of ordinary identifiers, for the labelled sample.
PARTS = (
    "get set user name list item count index value total first last time date file path line text word page size type code data base"
    " table column row key map node edge graph tree root leaf left right start end begin stop next prev parent child open close read"
    " write load save send parse format print error debug test main init config option param result response request server client"
    " session window button image color width height length offset buffer string number integer double float boolean array object"
    " class method function module package version build release update delete insert select create remove append merge split join"
    " filter sort group sum average minimum maximum random hash cache queue stack thread process task job batch stream event message"
    " http https www com org net html json xml csv utf page2 v2 v1 sha256 md5 base64 x86 64bit 2020 2021 2022 2023 2024 10 100 1000"
).split()
ALPHABETS = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
    "abcdefghijklmnopqrstuvwxyz0123456789",
    "0123456789abcdef",
)


def labelled_samples(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(text, random): strings of random characters over several alphabets, and ordinary tokens.

    Ordinary are identifiers in several styles, paths, rules of one character, numbers and dates.
    """
    ids = spark.range(rows)
    pick = lambda n, *k: F.pmod(F.xxhash64("id", *[F.lit(x) if isinstance(x, int) else x for x in k]), F.lit(n))
    alphabet = F.element_at(F.array(*[F.lit(x) for x in ALPHABETS]), (F.col("id") % len(ALPHABETS) + 1).cast("int"))
    drawn = lambda i: F.substr(alphabet, (F.pmod(F.xxhash64("id", i), F.length(alphabet)) + 1).cast("int"), F.lit(1))
    strings = ids.select(F.array_join(F.transform(F.sequence(F.lit(1), (pick(29, 0) + 20).cast("int")), drawn), "").alias("text"), F.lit(True).alias("random"))
    parts = F.array(*[F.lit(p) for p in PARTS])
    part = lambda k: F.element_at(parts, (pick(len(PARTS), k) + 1).cast("int"))
    words = [part(k) for k in range(1, 5)]
    styles = [
        F.concat_ws("_", *words),
        F.concat_ws("_", *[F.upper(w) for w in words]),
        F.concat(words[0], *[F.initcap(w) for w in words[1:]]),
        F.concat(*[F.initcap(w) for w in words]),
        F.concat_ws("/", *words),
        F.concat_ws("-", *words),
        F.concat(*words),
        F.concat(F.concat_ws("/", *words[:3]), F.lit("-"), pick(10_000, 9).cast("string")),
        F.repeat(F.element_at(F.split(F.lit("- = _ + / x 0 a"), " "), (pick(8, 10) + 1).cast("int")), 24),
        F.concat_ws("-", (pick(80, 11) + 1950).cast("string"), F.lpad((pick(12, 12) + 1).cast("string"), 2, "0"), F.lpad((pick(28, 13) + 1).cast("string"), 2, "0"), words[0], words[1]),
    ]
    style = F.col("id") % len(styles)
    plain = ids.select(F.coalesce(*[F.when(style == k, x) for k, x in enumerate(styles)]).alias("text"), F.lit(False).alias("random"))
    return strings.union(plain)


def corpus_words(docs: DataFrame, rows: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text, random): different words of a bounded sample of the documents, all ordinary.

    Of the texts of at most ``most_bytes`` bytes, the first ``rows`` by a hash of id and text are
    read whole.  What a pattern matches is left out, and so is a word of 16 characters or more,
    which may be a secret.  Null texts give nothing.
    """
    own = docs.where(F.octet_length("text") <= most_bytes).select(F.xxhash64("doc_id", "text").alias("key"), "text")
    first = own.select("key").distinct().orderBy("key").limit(rows)
    plain = F.regexp_replace("text", f"{ASSIGN}|{LONG_ACCESS}|{LONG_HEX}", " ")
    words = F.filter(F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9+/_=-]+"), F.lit(0)), lambda w: (F.length(w) >= 4) & (F.length(w) < 16))
    return own.join(F.broadcast(first), "key").select(F.explode(words).alias("text")).distinct().select("text", F.lit(False).alias("random"))


def _symbol(c: Column) -> Column:
    """1 to len(SYMBOLS) + 1; a dash and anything else share the last."""
    at = F.instr(F.lit(SYMBOLS), c)
    return F.when(at == 0, len(SYMBOLS) + 1).otherwise(at)


def fit(samples: DataFrame, smooth: float = SMOOTH) -> list[float]:
    """Log-likelihood ratios of each symbol pair, in (first - 1) * n + second order; n = len(SYMBOLS) + 1.

    Null texts and rows without a label are left out; repeated rows count again; without
    samples every ratio is 0.
    """
    n = len(SYMBOLS) + 1
    texts = samples.where("text is not null and random is not null")
    pairs = texts.select("random", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text") - 1, F.lit(1)))).alias("i"), "text").where(F.length("text") > F.col("i"))
    char = lambda i: F.expr(f"substring(text, {i}, 1)")
    counts = pairs.select("random", ((_symbol(char("i")) - 1) * n + _symbol(char("i + 1")) - 1).alias("pair")).groupBy("pair").agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("p"))
    seen = {row["pair"]: (row["r"], row["p"]) for row in counts.collect()}
    out = []
    for a in range(n):
        r, p = ([seen.get(a * n + b, (0, 0))[k] + smooth for b in range(n)] for k in (0, 1))
        out += [math.log(r[b] / sum(r)) - math.log(p[b] / sum(p)) for b in range(n)]
    return out


#: Matches of one text that are placed in one go; the work on a text grows with its matches times this.
TOGETHER = 128


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end, kind, value) of the matches of ``pattern``; value is the group's text."""
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        own = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    parts = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("match"), value.alias("value"))
    parts = F.transform(parts, lambda p: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), p["value"].alias("value")))
    # runs of TOGETHER matches from their own starts, and then each run moved by the length of those before
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / TOGETHER).cast("int")), lambda k: F.aggregate(F.slice(parts, k * TOGETHER + 1, F.lit(TOGETHER)), none, step))
    zero = F.array(F.lit(0))
    origins = F.aggregate(runs, zero, lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
    moved = F.zip_with(
        runs,
        F.slice(origins, F.lit(1), F.size(runs)),
        lambda r, at: F.transform(r["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))),
    )
    found = F.flatten(moved)
    return F.filter(found, lambda s: F.length(s["value"]) >= least) if least else found


def _ratio(value: Column, table: Column) -> Column:
    n = len(SYMBOLS) + 1
    chars = F.transform(F.split(value, ""), _symbol)
    pair = F.zip_with(F.slice(chars, F.lit(1), F.length(value) - 1), F.slice(chars, F.lit(2), F.length(value) - 1), lambda a, b: F.element_at(table, ((a - 1) * n + b).cast("int")))
    return F.aggregate(pair, F.lit(0.0), lambda s, x: s + x) / (F.length(value) - 1)


def secrets(docs: DataFrame, model: list[float], ratio: float = RATIO) -> DataFrame:
    """``docs`` with _spans: array of (start, end, kind, value), by start and then in the order of KINDS.

    Offsets are code points, end exclusive.  A null text counts as empty.  Matches of one
    kind never overlap; those of different patterns may, but a "markov" span gives way to any
    pattern's span.  Every row is decided alone.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    nothing = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    table = F.expr(f"cast(split('{','.join(f'{x:.6g}' for x in model)}', ',') as array<double>)")

    def of(pattern: str, kind: str, probe: str, group: int = 0, least: int = 0) -> Column:
        return F.when(text.rlike(probe), spans(text, pattern, kind, group, least)).otherwise(nothing)

    out = docs.select(whole(docs), "text")
    out = out.withColumn("_assign", of(ASSIGN, "assign", ASSIGN, 2, ASSIGN_CHARS))
    out = out.withColumn("_access", of(LONG_ACCESS, "access", LONG_ACCESS)).withColumn("_hex", of(LONG_HEX, "hex", LONG_HEX))
    out = out.withColumn("_base", F.concat("_assign", "_access", "_hex"))
    out = out.withColumn("_tokens", of(TOKEN, "markov", TOKEN))
    random = F.filter(
        "_tokens",
        lambda t: (~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))) & (_ratio(t["value"], table) > ratio),
    )
    place = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    ordered = F.array_sort(F.transform(F.concat("_base", random), lambda s: F.struct(s["start"].alias("start"), place(s).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))
    ordered = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return out.select(*fields(docs, without=("_spans",)), ordered.alias("_spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
