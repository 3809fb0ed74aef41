"""Word and line arithmetic on the bytes of many texts at once, with numpy.

A batch of texts is one byte array with offsets.  Spans get 64-bit hashes from prefix sums of two
polynomials over random byte values, so every word, line or word window costs a few array operations.
One polynomial is taken modulo 2**64; as that has well-known collisions for any base (Thue-Morse words),
the other, modulo the prime 2**31 - 1, goes into the hash too.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled by itself.
CHUNK = 1 << 18
U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWERED = BYTE.copy()
LOWERED[65:91] = BYTE[97:123]
WINDOW = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
#: The second polynomial: its prime modulus, its base, its byte values, and the factor with which it joins the first.
PRIME, BASE2, JOIN = 2**31 - 1, 1_103_527_591, U(0xD1342543DE82EF95)
BYTE2 = _RNG.integers(1, PRIME, 256, dtype=np.uint64)
LOWERED2 = BYTE2.copy()
LOWERED2[65:91] = BYTE2[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside of terms: all but digits, letters and the bytes of characters beyond ASCII.
NO_TERM = np.ones(256, bool)
NO_TERM[48:58] = NO_TERM[65:91] = NO_TERM[97:123] = NO_TERM[128:] = False
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # not glibc
    _LIBC = None
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_powers2: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(max(n, 2 * CHUNK), b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _power2(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE2 and its inverse to the powers 0..n-1, modulo PRIME."""
    if len(_powers2[0]) < n:
        for k, b in enumerate((BASE2, pow(BASE2, -1, PRIME))):
            p = np.ones(max(n, 2 * CHUNK), np.uint64)
            done = 1
            while done < len(p):
                more = p[done : 2 * done]
                more[:] = p[: len(more)] * U(pow(b, done, PRIME)) % U(PRIME)
                done *= 2
            _powers2[k] = p
    return _powers2[0][:n], _powers2[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def tidy() -> None:
    """Give memory that is free back to the system: workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


class Texts:
    """Some texts as bytes; off[i]:off[i + 1] are those of text i."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1
        self._sums: dict[bool, tuple[np.ndarray, np.ndarray]] = {}

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.off[1:]] - total[self.off[:-1]]

    def words(self, apart: np.ndarray = SPACE) -> None:
        """Sets start, end and text number of each maximal run of bytes that are not apart (white space), and first: the first word of each text."""
        filled = ~apart[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.off] = True
        before = np.concatenate(([False], filled[:-1])) if len(filled) else filled
        after = np.concatenate((filled[1:], [False])) if len(filled) else filled
        self.filled = filled
        self.start = np.flatnonzero(filled & (~before | edge[:-1]))
        self.end = np.flatnonzero(filled & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.of = np.repeat(np.arange(self.n), np.diff(self.first))

    def lines(self) -> None:
        """Sets line_start, line_end and line_of (text number) of the newline-separated lines; an empty text is one empty line."""
        at = np.flatnonzero(self.data == 10)
        of = np.concatenate((np.arange(self.n), np.searchsorted(self.off, at, "right") - 1))
        start = np.concatenate((self.off[:-1], at + 1))
        order = np.lexsort((start, of))
        self.line_start, self.line_of = start[order], of[order]
        end = self.off[self.line_of + 1]
        same = np.flatnonzero(self.line_of[1:] == self.line_of[:-1])
        end[same] = self.line_start[same + 1] - 1
        self.line_end = end

    def _totals(self, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums of both polynomials over the bytes."""
        if lower not in self._sums:
            n = len(self.data)
            total, total2 = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
            np.cumsum((LOWERED if lower else BYTE)[self.data] * _power(n)[0], out=total[1:])
            term = (LOWERED2 if lower else BYTE2)[self.data]
            term *= _power2(n)[0]
            low = term & U(PRIME)  # nearly reduced: below 2**32
            term >>= U(31)
            low += term
            np.cumsum(low, out=total2[1:])
            self._sums[lower] = total, total2
        return self._sums[lower]

    def pairs(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Both polynomials of each span, as if it stood at the texts' begin."""
        total, total2 = self._totals(lower)
        n = len(self.data) + 1
        return (total[end] - total[start]) * _power(n)[1][start], (total2[end] - total2[start]) % U(PRIME) * _power2(n)[1][start] % U(PRIME)

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """One hash of both; spans that differ in the second polynomial alone differ for certain."""
        first, second = self.pairs(start, end, lower)
        return mix(first + second * JOIN)

    def windows(self, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each run of size words within a text, from the hashes of the words."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = words[:n] * WINDOW[0]
        for j in range(1, size):
            h = h + words[j : j + n] * WINDOW[j]
        inside = np.flatnonzero(self.of[:n] == self.of[size - 1 :])
        return mix(h[inside]), inside


def code_points(data: np.ndarray) -> np.ndarray:
    """Whether a byte begins a code point."""
    return (data & 0xC0) != 0x80


def batches(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """Row ranges of a string array with their Texts, of limit bytes or one row each; null is empty."""
    end = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + limit, "right")))
        part = column.slice(lo, hi - lo)
        if part.null_count:
            part = pc.fill_null(part, "")
        wide = np.int64 if pa.types.is_large_string(part.type) else np.int32
        off = np.frombuffer(part.buffers()[1], wide)[part.offset : part.offset + len(part) + 1].astype(np.int64)
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] else np.zeros(0, np.uint8)
        yield lo, hi, Texts(data[off[0] : off[-1]], off - off[0])
        lo = hi
    tidy()
