"""Elias-Fano coded monotone sequences in arrays of 64-bit words, queried in bulk with numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONE = _U(1)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width fields, lowest bits first; one spare word at the end."""
    n = len(values)
    out = np.zeros((n * width + 63) // 64 + 2, _U)
    if width and n:
        at = np.arange(n, dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(_U)
        np.bitwise_or.at(out, word, values << shift)
        over = (at & 63) + width > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (_U(64) - shift[over]))
    return out


_ONES, _HIGHS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the set bit number r (from 0) of a byte b, at b | r << 8.
_IN_BYTE = np.array([next((i for i in range(8) if b >> i & 1 and (b & ((1 << i) - 1)).bit_count() == r), 0) for r in range(8) for b in range(256)], np.int64)


def _select_in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the set bit number ``rank`` (from 0) in each word: counts of set bits by byte, then a table."""
    x = words - ((words >> _ONE) & _U(0x5555555555555555))
    x = (x & _U(0x3333333333333333)) + ((x >> _U(2)) & _U(0x3333333333333333))
    sums = ((x + (x >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # up to and with each byte
    rank = rank.astype(_U)
    place = np.bitwise_count(((rank * _ONES | _HIGHS) - sums) & _HIGHS).astype(_U) << _U(3)
    inside = rank - (((sums << _U(8)) >> place) & _U(0xFF))
    return place.astype(np.int64) + _IN_BYTE[((words >> place) & _U(0xFF)) | (inside << _U(8))]


class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit values.

    ``low`` holds the low bits, ``high`` the unary-coded high parts and
    ``ranks`` the set bits of ``high`` before each of its words.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.width, self.low, self.high, self.ranks = n, width, low, high, ranks

    @staticmethod
    def of(values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, _U)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        mask = _U((1 << width) - 1)
        ones = (values >> _U(width)).astype(np.int64) + np.arange(n)
        size = (int(ones[-1]) + 1 if n else 0) // 64 + 2
        high = np.zeros(size, _U)
        np.bitwise_or.at(high, ones >> 6, _ONE << (ones & 63).astype(_U))
        ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(high), dtype=np.int64)))[:-1]
        return EliasFano(n, width, _pack(values & mask, width), high, ranks.astype(np.uint32))

    def words(self) -> list[np.ndarray]:
        """Sections to write: a header and the three parts as 64-bit words."""
        pad = self.ranks if len(self.ranks) % 2 == 0 else np.append(self.ranks, np.uint32(0))
        return [np.array([self.n, self.width, len(self.low), len(self.high)], _U), self.low, self.high, pad.view(_U)]

    @staticmethod
    def read(words: np.ndarray, at: int) -> tuple["EliasFano", int]:
        """The sequence whose header is at word ``at`` of a mapped file, and the word after it."""
        n, width, n_low, n_high = (int(x) for x in words[at : at + 4])
        a = at + 4
        b = a + n_low
        c = b + n_high
        end = c + (n_high + 1) // 2
        return EliasFano(n, width, words[a:b], words[b:c], words[c:end].view(np.uint32)[:n_high]), end

    def _low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), _U)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(_U)
        out = self.low[word] >> shift
        spill = np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return (out | spill) & _U((1 << self.width) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions ``i``."""
        word = np.searchsorted(self.ranks, i.astype(np.uint32), side="right") - 1
        place = (word << 6) + _select_in_word(self.high[word], i - self.ranks[word])
        return ((place - i).astype(_U) << _U(self.width)) | self._low_bits(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """First position whose value is at least ``x`` in the whole sequence."""
        return self._bisected(x)[0]

    def index(self, x: np.ndarray) -> np.ndarray:
        """First position of each value of ``x``, -1 where it is not there."""
        at, end = self._bisected(x)
        there = at < end
        return np.where(there & (self._low_bits(np.where(there, at, 0)) == (x & _U((1 << self.width) - 1))), at, -1)

    def _bisected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``find`` gives, and the end of the values that share the high bits of ``x``.

        The zeros of the high part delimit those values, so only they are
        bisected, for all queries at once, and only low bits are compared.
        """
        part, low = (x >> _U(self.width)).astype(np.int64), x & _U((1 << self.width) - 1)
        begin, stop = self._zeros_rank(part - 1), self._zeros_rank(part)
        end = stop.copy()
        live = np.flatnonzero(begin < end)
        while len(live):
            mid = (begin[live] + end[live]) >> 1
            less = self._low_bits(mid) < low[live]
            begin[live[less]] = mid[less] + 1
            end[live[~less]] = mid[~less]
            live = live[begin[live] < end[live]]
        return begin, stop

    def _zeros_rank(self, part: np.ndarray) -> np.ndarray:
        """Number of values whose high bits are at most ``part``."""
        if not hasattr(self, "_zeros"):
            self._zeros = (np.arange(len(self.ranks), dtype=np.int64) << 6) - self.ranks
        out = np.zeros(len(part), np.int64)
        inside = part >= 0
        p = part[inside]
        total = int(self._zeros[-1]) + 64 - int(np.bitwise_count(self.high[-1]))
        far = p >= total
        q = np.where(far, 0, p)
        word = np.searchsorted(self._zeros, q, side="right") - 1
        place = (word << 6) + _select_in_word(~self.high[word], q - self._zeros[word])
        out[inside] = np.where(far, self.n, place - q)
        return out
