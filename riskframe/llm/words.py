"""Words of many texts at once, as numpy arrays over the bytes of an Arrow string column.

A word is a maximal run of word bytes in the UTF-8 text. Each word gets a 64-bit hash of its
bytes (a polynomial over the whole run, so equal words have equal hashes wherever they stand),
and a window of consecutive words gets a hash of its words' hashes in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 20
SLICE_BYTES = 1 << 20


def _space_words() -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[[0x20, *range(0x09, 0x0E)]] = False
    return out


def _alnum_words() -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for lo, hi in ((0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0x80, 0xFF)):
        out[lo : hi + 1] = True
    return out


#: Word bytes: all but ASCII white space; or ASCII letters and digits and whatever isn't ASCII.
SPACED, ALNUM = _space_words(), _alnum_words()
LOWER = bytes(range(256)).lower()  # of the ASCII letters alone


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
    return values[np.frombuffer(LOWER, dtype=np.uint8)] if lower else values


@lru_cache(maxsize=4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = pow(BASE, -1, 1 << 64) if inverse else BASE
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.cumprod(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    size = BLOCK
    while size < n:
        size *= 2
    return _powers(size, inverse)[:n]


@dataclass
class Words:
    """Words of the texts of one slice. first[d] is the index of text d's first word."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64 bits for each word, in blocks, so that a very long text takes no more room."""
        out, values = np.empty(len(self.start), dtype=U64), byte_values(lower)
        lo = 0
        while lo < len(self.start):
            a = int(self.start[lo])
            hi = max(lo + 1, int(np.searchsorted(self.end, a + BLOCK, side="right")))
            b = int(self.end[hi - 1])
            sums = np.zeros(b - a + 1, dtype=U64)
            np.cumsum(values[self.data[a:b]] * powers(b - a), out=sums[1:])
            s, e = self.start[lo:hi] - a, self.end[lo:hi] - a
            out[lo:hi] = (sums[e] - sums[s]) * powers(b - a, True)[s]
            lo = hi
        return mix(out)

    def whole_windows(self, size: int) -> np.ndarray:
        """For each start of a window in the slice, whether the window lies within one text."""
        n = max(0, len(self.start) - size + 1)
        owner = self.text_of_word()
        return owner[:n] == owner[size - 1 : size - 1 + n]

    def summed(self, per_word: np.ndarray) -> np.ndarray:
        """Sum of a value of each word, for each text."""
        total = np.zeros(len(per_word) + 1, dtype=np.float64 if per_word.dtype.kind == "f" else np.int64)
        np.cumsum(per_word, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """64 bits for each run of ``size`` neighbours."""
    n = max(0, len(hashes) - size + 1)
    out = np.empty(n, dtype=U64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        part = hashes[a : b + size - 1]
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(part * powers(len(part)), out=sums[1:])
        out[a:b] = (sums[size:] - sums[: b - a]) * powers(b - a, True)
    return mix(out)


def read_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = SPACED) -> Words:
    """Words of the texts whose bytes are data[offsets[d]:offsets[d + 1]]; offsets[0] is 0."""
    inside = word_bytes[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    opens[heads], closes[tails] = inside[heads], inside[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, bytes, offsets) of runs of rows with about ``most`` bytes, one row at least. A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte, and in all: length of data + 1."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
