"""Word and shingle hashes of UTF-8 text, computed on Arrow buffers inside tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Words are never
turned into Python strings: a 64-bit polynomial hash of every word comes from one
running sum over the bytes of a slice.  Slices are cut at documents, and inside a
very long document at white space, so memory follows the slice and not the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_JOIN = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers[:] = [
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, dtype=np.uint64)]), dtype=np.uint64)
            for x in (_BASE, _BASE_INVERSE)
        ]
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def bounds(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of bytes outside ``gaps``; none crosses a row."""
    word = ~gaps[data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    return starts, np.flatnonzero(word & ~after) + 1


def span_sums(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of start and end bytes that gives unfinished hashes (``mix`` finishes them) of these spans of one slice."""
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODE[data] * power[: len(data)], out=total[1:])
    return lambda starts, ends: (total[ends] - total[starts]) * inverse[starts]


def joined_sums(left: np.ndarray, size: int, right: np.ndarray) -> np.ndarray:
    """The unfinished hashes of spans of ``size`` bytes followed by others."""
    return left + right * np.uint64(pow(_BASE, size, 1 << 64))


def span_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of start and end bytes that gives 64-bit hashes of these spans of one slice."""
    sums = span_sums(data)
    return lambda starts, ends: mix(sums(starts, ends))


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Unfinished hashes (``mix`` finishes them) of all spans of ``size`` bytes of one slice."""
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_CODE[data] * power[: len(data)], out=total[1:])
    out = total[size:] - total[:-size]
    out *= inverse[: len(out)]
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hasher(data)(starts, ends)


def chunks(data: np.ndarray, most: int = SLICE_BYTES, gaps: np.ndarray = SPACE, behind: bool = False) -> Iterator[np.ndarray]:
    """A long text in pieces that begin at a byte in ``gaps``, or right ``behind`` one."""
    lo, back = 0, int(behind)
    while lo < len(data):
        hi = min(lo + max(most, back + 1), len(data))
        while hi < len(data) and not gaps[data[hi - back]]:
            gap = np.flatnonzero(gaps[data[hi - back : hi - back + most]])
            hi = hi + int(gap[0]) if len(gap) else min(hi + most, len(data))
        yield data[lo:hi]
        lo = hi


def word_hashes(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows lo..hi: the hashes of its words and hi - lo + 1 offsets into them."""
    data, offsets = buffers(column)
    for lo, hi in slices(offsets):
        part = data[offsets[lo] : offsets[hi]]
        at = offsets[lo : hi + 1] - offsets[lo]
        if hi == lo + 1 and len(part) > SLICE_BYTES:
            found = []
            for piece in chunks(part):
                piece = LOWER[piece] if lower else piece
                starts, ends = bounds(piece, np.array([0, len(piece)]))
                found.append(span_hashes(piece, starts, ends))
            hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield lo, hi, hashes, np.array([0, len(hashes)])
            continue
        part = LOWER[part] if lower else part
        starts, ends = bounds(part, at)
        yield lo, hi, span_hashes(part, starts, ends), np.searchsorted(starts, at)


def shingles(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words per row; a row with fewer words gives its whole sequence.

    Returns the hashes in text order (repeats kept) and the offsets per row.
    """
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_offsets = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    first = offsets[:-1][row] + np.arange(out_offsets[-1]) - out_offsets[:-1][row]
    taken = np.minimum(n, size)[row]
    out = taken.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for j in range(size):
        step = out * _JOIN + padded[first + j]
        out = step if j == 0 else np.where(j < taken, step, out)
    return mix(out), out_offsets


def string_hash(text: str, lower: bool = True) -> int:
    """The hash that ``word_hashes`` gives to one word."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    data = LOWER[data] if lower else data
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def row_shingles(column: pa.Array, size: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and the sorted distinct shingle hashes of each row, row by row."""
    for lo, hi, words, offsets in word_hashes(column, lower):
        hashes, at = shingles(words, offsets, size)
        for k in range(hi - lo):
            yield lo + k, np.unique(hashes[at[k] : at[k + 1]])
