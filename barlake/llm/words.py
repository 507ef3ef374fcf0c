"""Words, word hashes and word n-grams of whole Arrow columns, with numpy.

A text column is one byte buffer with row offsets.  Words are found by a
256-entry byte table (0 separates, anything else is the byte to hash), and
every word gets a 64-bit hash from one running polynomial sum, so there is no
Python work per row or per word.  UTF-8 bytes of non-ASCII characters are all
128 or above, which lets byte tables express the ASCII word classes exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(None)
def space_table() -> np.ndarray:
    """Words are runs of anything but space and 09-0D; A-Z become a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    # NUL is a word byte here: give it a value no other byte of UTF-8 text has.
    table[0] = 0xFF
    table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
    return table


@lru_cache(None)
def alnum_table() -> np.ndarray:
    """Words are runs of 0-9, a-z and everything beyond ASCII; A-Z become a-z."""
    table = np.zeros(256, dtype=np.uint8)
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    table[keep] = keep
    table[65:91] = np.arange(97, 123)
    return table


@lru_cache(None)
def line_table() -> np.ndarray:
    """"Words" are non-empty lines, case kept."""
    table = np.arange(256, dtype=np.uint8)
    table[0] = 0xFF
    table[0x0A] = 0
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _STEP
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_BASE)
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        if n > SLICE_BYTES + 1:  # a single long text: not kept
            return np.cumprod(up), np.cumprod(down)
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of some rows: ``hashes[offsets[i]:offsets[i + 1]]`` are those of row i."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words of the rows bounded by ``offsets``; positions count from ``offsets[0]``."""
    base = int(offsets[0])
    rows = offsets - base
    b = table[data[base : int(offsets[-1])]]
    n = len(b)
    word = b != 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = rows[(rows > 0) & (rows < n)]
    first[inner] |= word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner - 1] |= word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(span_hashes(b, starts, ends), np.searchsorted(starts, rows), starts, ends)


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes (and the length) of each range of ``b``."""
    n = len(b)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(b * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each ``k`` consecutive values; rows are not told apart."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xA0761D6478BD642F)
        out += hashes[j : j + n]
    return mix(out + np.uint64(k))


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct ``k``-word shingles of each row; all words as one if fewer."""
    all_grams = grams(words.hashes, k)
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(all_grams[a : b - k + 1])
        elif b > a:
            yield grams(words.hashes[a:b], b - a)
        else:
            yield all_grams[:0]
