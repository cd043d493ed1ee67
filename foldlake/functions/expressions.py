"""Scalar expressions: vectors, ids, scores and text, all as Spark columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot_with(vector: Column, values: Sequence[float]) -> Column:
    """Inner product with a known vector, unrolled so that it stays in generated code."""
    return reduce(lambda a, b: a + b, [F.get(vector, F.lit(i)).cast("double") * F.lit(float(v)) for i, v in enumerate(values)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column, least: float = 1e-12) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(least))


def similarity(cosine: Column) -> Column:
    """A cosine mapped to 0..1."""
    return (1 + cosine) / 2


def half_up(x: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(x + 0.5)


def is_permutation_candidate(inv: Column, ordered: Column, high: float = 0.9, low: float = 0.6) -> Column:
    """Alike whatever the order, unlike in order; both bounds are strict."""
    return (ordered < low) & (inv > high)


def log_closeness(v: Column, eps: float = 2e-3) -> Column:
    """log10 of the distance from a perfect score, as a share of its largest value."""
    return F.log10(1 / F.greatest(F.lit(eps), 1 - v)) / F.log10(F.lit(1 / eps))


def sharp_ramp(v: Column, cutoff: float, eps: float = 2e-3) -> Column:
    """A score's tint: up to 0.28 below the cutoff and from 0.62 on above, along ``log_closeness``."""
    p, at = log_closeness(v, eps), log_closeness(F.lit(cutoff), eps)
    over = 0.62 + 0.38 * F.least(F.lit(1.0), (p - at) / F.greatest(F.lit(1e-6), 1 - at))
    return F.when(p <= 0, F.lit(0.0)).when(v < cutoff, 0.28 * (p / at)).otherwise(over)


def delta_ramp(d: Column, cutoff: float) -> Column:
    """A difference's tint: linear up to four cutoffs, weaker below the cutoff, none unless positive."""
    return F.when(d <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), d / (cutoff * 4)) * F.when(d >= cutoff, 1.0).otherwise(0.45))


def signed(x: Column, digits: int = 2) -> Column:
    """Fixed digits with a sign, none on zero."""
    text = F.format_string(f"%.{digits}f", F.abs(x))
    zero = F.format_string(f"%.{digits}f", F.lit(0.0))
    return F.when(text == zero, zero).when(x < 0, F.concat(F.lit("-"), text)).otherwise(F.concat(F.lit("+"), text))


def search_scale(n: Column) -> Column:
    """Distance scale of the structural search for chains of length ``n``."""
    return F.when(n <= 19, F.lit(0.168)).otherwise(1.24 * F.cbrt(n - 15) - 1.8) + 0.8


def final_scale(n: Column) -> Column:
    """Distance scale of the final score."""
    return F.greatest(F.lit(0.5), F.when(n <= 21, F.lit(0.5)).otherwise(1.24 * F.cbrt(n - 15) - 1.8))


def score_cutoff(n: Column) -> Column:
    return 1.5 * F.pow(n.cast("double"), 0.3) + 3.5


def field_value(d2: Column, d0: Column) -> Column:
    """Closeness of a pair on a byte scale."""
    return half_up(255 / (1 + d2 / (d0 * d0))).cast("int")


def cosine_value(cosine: Column) -> Column:
    """A cosine on a byte scale, negative ones at 0."""
    return F.when(cosine <= 0, F.lit(0)).otherwise(F.least(F.lit(255), half_up(cosine * 255))).cast("int")


BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pack_id(accession: Column, index: Column) -> Column:
    """A 6- or 10-character base-36 accession and a small number as one long.

    Bit 0 tells the long form, bits 1 to 8 are the index, the rest is the accession.
    """
    digits = F.transform(F.split(accession, ""), lambda c: (F.instr(F.lit(BASE36), c) - 1).cast("long"))
    value = F.aggregate(digits, F.lit(0).cast("long"), lambda s, d: s * 36 + d)
    return F.shiftleft(value, 9).bitwiseOR(F.shiftleft(index.cast("long"), 1)).bitwiseOR((F.length(accession) == 10).cast("long"))


def unpack_accession(packed: Column) -> Column:
    size = F.when(packed.bitwiseAND(F.lit(1)) == 1, 10).otherwise(6)
    return F.lpad(F.conv(F.shiftright(packed, 9).cast("string"), 10, 36), size, "0")


def unpack_index(packed: Column) -> Column:
    return F.shiftright(packed, 1).bitwiseAND(F.lit(255)).cast("int")


def piece_key(label: Column, number: Column, span: int) -> Column:
    """One long for piece ``number`` of a chain: label * span + number below ``span``, every further ``span`` pieces 2**40 higher.

    No two pieces share a key while abs(label) * span stays under 2**39.
    """
    label, number = label.cast("long"), number.cast("long")
    return label * span + number % span + F.floor(number / span) * F.lit(1 << 40)


def next_piece(key: Column, span: int) -> Column:
    """The ``piece_key`` of the following piece of the chain."""
    return F.when(F.pmod(key - F.shiftright(key + F.lit(1 << 39), 40) * F.lit(1 << 40), F.lit(span)) < span - 1, key + 1).otherwise(key + F.lit((1 << 40) - span + 1))


def piece_layer(key: Column) -> Column:
    """How many times ``span`` pieces come before a ``piece_key`` in its chain."""
    return F.shiftright(key + F.lit(1 << 39), 40)


def piece_name(key: Column, span: int) -> Column:
    """label * span + number of a ``piece_key``: the number that pieces of different chains share once chains have over ``span`` pieces."""
    return key - piece_layer(key) * F.lit((1 << 40) - span)


def cluster_path(cluster: Column, fanout: int = 256) -> Column:
    """Two lower-case hex digits of cluster / fanout, then the cluster."""
    return F.concat(F.lpad(F.lower(F.hex(F.floor(cluster / fanout))), 2, "0"), F.lit("/"), cluster.cast("string"))


def guess_format(text: Column) -> Column:
    """mmcif if a line begins with data_ or an _atom_site. name occurs, else pdb."""
    return F.when(text.rlike(r"(?m)^\s*data_") | text.contains("_atom_site."), F.lit("mmcif")).otherwise(F.lit("pdb"))


def leading_number(text: Column) -> Column:
    """The number at the front of a text, whatever follows; null if there is none."""
    return F.regexp_extract(F.trim(text), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")


def display_id(name: Column) -> Column:
    """Domain names as shown: a model's accession with its domain number, a classified domain without its padding."""
    model = r"^AF-([A-Z0-9]+)-F\d+-model_v\d+(?:_TED(\d+))?$"
    scoped = r"^d([0-9a-z]{4})([a-z0-9_.])([a-z0-9_])$"
    return (
        F.when(name.rlike(model), F.concat_ws("/", F.regexp_extract(name, model, 1), F.nullif(F.regexp_extract(name, model, 2), F.lit(""))))
        .when(name.rlike(scoped), F.concat(F.upper(F.regexp_extract(name, scoped, 1)), F.lit("_"), F.upper(F.regexp_extract(name, scoped, 2))))
        .otherwise(name)
    )


_WORD = (1 << 32) - 1
# The step of the seeded generator and the shifts and factors of its mixing.
_STEP, _SHIFTS, _ODD = 0x9E3779B9, (15, 7, 14), (1, 61)


def _product(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two numbers of 32 bits, without leaving 63 bits."""
    low, high = b.bitwiseAND(F.lit(0xFFFF)), F.shiftright(b, 16)
    return (a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_WORD))


def seeded_draw(seed: Column, k: Column) -> Column:
    """The k-th number (from 0) in [0, 1) of a generator of 32 bits; any can be had without those before it.

    ``seed`` counts modulo 2^32.  The state of draw k is the seed and k + 1 steps, and two rounds of
    shifts and products mix it.
    """
    # each step is bound once: written out, the uses of its uses would double from step to step
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    fold = lambda x, n: x.bitwiseXOR(F.shiftright(x, n))
    mixed = lambda t, k: _product(fold(t, _SHIFTS[k]), t.bitwiseOR(F.lit(_ODD[k])))
    state = (seed.cast("long").bitwiseAND(F.lit(_WORD)) + (k.cast("long") + 1) * F.lit(_STEP)).bitwiseAND(F.lit(_WORD))
    last = lambda t: bound(t.bitwiseXOR((t + mixed(t, 1)).bitwiseAND(F.lit(_WORD))), lambda u: fold(u, _SHIFTS[2]))
    return bound(state, lambda t: bound(mixed(t, 0), last)) / F.lit(float(1 << 32))


def seeded_normal(seed: Column, k: Column) -> Column:
    """The k-th normal number: draws come in pairs, which give a radius and a turn to two numbers."""
    pair = k - k % 2
    radius = F.sqrt(-2 * F.log(F.greatest(seeded_draw(seed, pair), F.lit(1e-12))))
    turn = 2 * math.pi * seeded_draw(seed, pair + 1)
    return radius * F.when(k % 2 == 0, F.cos(turn)).otherwise(F.sin(turn))
