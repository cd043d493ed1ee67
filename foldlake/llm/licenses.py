"""License notices in texts, by MinHash over overlapping windows and exact containment.

Texts are sequences of words (runs of letters and digits, ASCII lower case) and of their
five-word shingles.  An occurrence of a template may be longer than it by ``INSERTED`` of its
length, all its insertions together.  Templates are grouped by length.  For a group, windows
a little longer than its longest occurrence begin every few shingles, so that every
occurrence lies wholly in a window and a window's Jaccard similarity to a template contained
to ``CONTAINMENT`` has a known floor.  Bands of one MinHash coordinate each, as many as that
floor needs for a collision probability of ``COLLISION``, retrieve (window, template) pairs.

A retrieved template is then placed exactly in its text.  A span runs from one of the
template's shingles to another that it does not hold before, and is no longer than an
occurrence may be; it holds the share of the template's distinct shingles that lie in it.  Of
the spans that hold ``CONTAINMENT`` the fullest is a place, of equals the one nearest to the
template's length, then the first; the next place is sought among the spans that overlap none
before.  So each of several adjacent notices has its place.

The templates are a fixed, short list that travels with the task; documents are read in
place, whole, and nothing is shuffled.
"""

from __future__ import annotations

import bisect
import heapq
import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_type

from . import words as W
from .shared import fields, mapped

SHINGLE, CONTAINMENT, COLLISION, INSERTED = 5, 0.8, 0.9999, 0.5

# Notices by which well-known licenses are applied, and full texts of short ones.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        " the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at"
    ),
    "gpl-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
        " file, You can obtain one at"
    ),
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
        ' substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING'
        " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
        " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,"
        " ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        ' the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS'
        " ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE"
        " AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA"
        " OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR"
        " PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
        " are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        ' documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS'
        ' "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR'
        " A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,"
        " INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;"
        " LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT"
        " LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE"
        " POSSIBILITY OF SUCH DAMAGE."
    ),
}

_GAPS = np.ones(256, dtype=bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 1 << 32, 64, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, 64, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


@lru_cache(1 << 16)
def _mixing(i: int) -> tuple[np.uint32, np.uint32]:
    """The two constants of coordinate i, however many bands a setting takes."""
    if i < len(_XOR):
        return _XOR[i], _MUL[i]
    rng = np.random.default_rng((77, i))
    return np.uint32(rng.integers(0, 1 << 32)), np.uint32(rng.integers(0, 1 << 31) * 2 + 1)


def bands_for(similarity: float, probability: float = COLLISION) -> int:
    """Bands of one coordinate that collide with at least ``probability`` at ``similarity``."""
    return 1 if similarity >= 1 else math.ceil(math.log(1 - probability) / math.log(1 - similarity))


def _coordinate(low: np.ndarray, i: int) -> np.ndarray:
    x, m = _mixing(i)
    v = (low ^ x) * m
    v ^= v >> np.uint32(15)
    return v * np.uint32(0x2C1B3C6D)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a slice in bytes, and the rows' offsets into them."""
    if len(offsets) == 2 and len(data) > W.SLICE_BYTES:
        at, parts = 0, []
        for piece in W.chunks(data, gaps=_GAPS):
            low = W.LOWER[piece]
            s, e = W.bounds(low, np.array([0, len(low)]), _GAPS)
            parts.append((s + at, e + at, W.span_hashes(low, s, e)))
            at += len(piece)
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    else:
        low = W.LOWER[data]
        starts, ends = W.bounds(low, offsets, _GAPS)
        hashes = W.span_hashes(low, starts, ends)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


@dataclass
class Group:
    """Templates of like length, the windows that hold them and the bands that retrieve them."""

    names: list[str]
    sets: list[np.ndarray]
    own: list[int]
    longest: list[int]
    window: int
    stride: int
    bands: int
    minima: np.ndarray


def groups(templates: dict[str, str], size: int = SHINGLE, share: float = CONTAINMENT, probability: float = COLLISION, inserted: float = INSERTED) -> list[Group]:
    """Templates grouped so that the longest of a group has at most 1.25 times the shingles of its shortest.

    A template without a word is left out; one of fewer words than a shingle is one shingle.
    """
    found = []
    for name, text in templates.items():
        data, offsets = W.buffers(pa.array([text]))
        _, _, hashes, at = _spans(data, offsets)
        own, _ = W.shingles(hashes, at, size)
        if len(own):
            found.append((len(own), name, np.unique(own)))
    found.sort(key=lambda x: x[:2])
    out = []
    while found:
        part = [x for x in found if x[0] <= max(found[0][0], int(1.25 * found[0][0]))]
        found = found[len(part) :]
        shortest = min(len(x[2]) for x in part)
        stride = max(1, shortest // 4)
        most = [x[0] + int(inserted * x[0]) for x in part]
        window = max(most) + stride - 1
        # the worst case: the window holds the least share of the shortest template and nothing else in common
        common = math.ceil(share * shortest)
        bands = bands_for(common / (window + shortest - common), probability)
        minima = np.array([[_coordinate((s >> np.uint64(32)).astype(np.uint32), i).min() for s in (x[2] for x in part)] for i in range(bands)], dtype=np.uint32)
        out.append(Group([x[1] for x in part], [x[2] for x in part], [x[0] for x in part], most, window, stride, bands, minima))
    return out


def _window_minima(values: np.ndarray, window: int, stride: int) -> np.ndarray:
    """Minima of ``window`` values from every ``stride``-th position on; the last windows are shorter."""
    low, width = values, 1
    while 2 * width <= window:
        low = np.minimum(low, np.concatenate([low[width:], np.full(min(width, len(low)), 0xFFFFFFFF, np.uint32)])[: len(low)])
        width *= 2
    rest = window - width
    if rest:
        low = np.minimum(low, np.concatenate([low[rest:], np.full(min(rest, len(low)), 0xFFFFFFFF, np.uint32)])[: len(low)])
    return low[::stride]


def places(at: np.ndarray, kind: np.ndarray, need: float, own: int, longest: int) -> list[tuple[int, int, int]]:
    """(first, last, held) of one template: ``at`` are the ascending shingles that it has, ``kind`` which of its own each is.

    ``held`` is the number of kinds from first to last, at least ``need``; the template has ``own`` shingles, spans at most ``longest``.
    """
    n = len(at)
    before = np.full(n, -1, dtype=np.int64)  # where the same kind was last
    order = np.lexsort((at, kind))
    again = kind[order][1:] == kind[order][:-1]
    before[order[1:][again]] = at[order[:-1][again]]
    reach = np.searchsorted(at, at + longest)  # the hits behind the longest span from each

    def best(i: int, stop: int) -> tuple[int, int, int, int] | None:
        new = np.flatnonzero(before[i:stop] < at[i])
        return (-len(new), abs(int(at[i + new[-1]] - at[i]) + 1 - own), i, int(at[i + new[-1]])) if len(new) >= need else None

    heap = [x for i in range(n) if reach[i] - i >= need and (x := best(i, int(reach[i])))]
    heapq.heapify(heap)
    firsts, lasts, out = [], [], []
    while heap:
        held, _, i, last = heapq.heappop(heap)
        k = bisect.bisect_right(firsts, at[i])
        if k and lasts[k - 1] >= at[i]:
            continue
        if k < len(firsts) and firsts[k] <= last:  # what is left of it before the next place
            left = best(i, int(np.searchsorted(at, firsts[k])))
            if left:
                heapq.heappush(heap, left)
            continue
        firsts.insert(k, int(at[i]))
        lasts.insert(k, last)
        out.append((int(at[i]), last, -held))
    return out


def _matches(hashes: np.ndarray, offsets: np.ndarray, parts: list[Group], share: float) -> list[tuple[int, str, int, int, float]]:
    """(row, template, first, last, containment): the shingles from first to last, counted in the row."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    pairs: list[set[tuple[int, int]]] = [set() for _ in parts]
    for i in range(max((g.bands for g in parts), default=0)):
        values = _coordinate(low, i)
        for g, met in zip(parts, pairs, strict=True):
            if i < g.bands and len(values):
                minima = _window_minima(values, g.window, g.stride)
                for t, m in enumerate(g.minima[i]):
                    for w in np.flatnonzero(minima == m):
                        a, b = int(w) * g.stride, min(int(w) * g.stride + g.window, len(hashes))
                        first = int(np.searchsorted(offsets, a, side="right")) - 1
                        met.update((row, t) for row in range(first, int(np.searchsorted(offsets, b))))
    out = []
    for g, met in zip(parts, pairs, strict=True):
        for row, t in sorted(met):
            own = hashes[offsets[row] : offsets[row + 1]]
            kind = np.minimum(np.searchsorted(g.sets[t], own), len(g.sets[t]) - 1)
            at = np.flatnonzero(g.sets[t][kind] == own)
            need = share * len(g.sets[t])
            if len(at) >= need:
                out += [(row, g.names[t], first, last, held / len(g.sets[t])) for first, last, held in places(at, kind[at], need, g.own[t], g.longest[t])]
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, size: int = SHINGLE, share: float = CONTAINMENT, inserted: float = INSERTED) -> DataFrame:
    """``docs`` with licenses: array of (template, start, end, containment), code points, end exclusive, by start and template.

    Places of one template never overlap; those of different templates may, as some contain
    others.  A null text and one without words hold nothing; rows are decided alone, so
    repeated rows agree.  A column licenses of the input is replaced; all others keep their
    names and values.
    """
    parts = groups(templates if templates is not None else TEMPLATES, size, share, inserted=inserted)
    item = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def kernel(text: pa.Array) -> list[pa.Array]:
        data, offsets = W.buffers(text)
        found: list[list[dict]] = [[] for _ in range(len(text))]
        for lo, hi in W.slices(offsets):
            part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, words, word_at = _spans(part, at)
            hashes, shingle_at = W.shingles(words, word_at, size)
            matches = _matches(hashes, shingle_at, parts, share)
            if not matches:
                continue
            chars = np.zeros(len(part) + 1, dtype=np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
            for row, name, first, last, held in matches:
                final = min(int(word_at[row]) + last + size, int(word_at[row + 1])) - 1
                begin, end = (int(chars[x] - chars[at[row]]) for x in (starts[word_at[row] + first], ends[final]))
                found[lo + row].append({"template": name, "start": begin, "end": end, "containment": held})
        for own in found:
            own.sort(key=lambda x: (x["start"], x["template"]))
        return [pa.array(found, item)]

    out = mapped(docs, kernel, licenses=from_arrow_type(item))
    return out.select(*fields(docs, without=("licenses",)), "licenses")
