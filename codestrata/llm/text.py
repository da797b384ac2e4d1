"""Words of whole Arrow batches as arrays: hashes, offsets and windows, without a Python object per word.

A word is a run of bytes other than space and 0x09 to 0x0D.  Its hash is a polynomial over random byte values; the hash
of a window of words is a polynomial over word hashes.  Both come from differences of running sums, so every step is a
pass over an array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20  # texts are taken in slices of about this size, a longer text alone
BASE = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Separators if only letters and digits make words: all other ASCII.
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = False
_POWERS: dict[np.uint64, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the powers 0 to n at least."""
    known = _POWERS.get(base)
    if known is None or len(known) <= n:
        known = np.full(max(n + 1, 1 << 16), base, np.uint64)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that makes all bits depend on all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _running(x: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x * powers(BASE, n)[:n], dtype=np.uint64, out=total[1:])
    return total


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive entries; windows may cross texts, see Words.inside."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = h[: n - k + 1].copy()
        for j in range(1, k):
            out = out * BASE + h[j : n - k + 1 + j]
        return mix(out)
    total = _running(h, n)
    return mix((total[k:] - total[:-k]) * powers(INVERSE, n)[: n - k + 1])


def lowered(data: np.ndarray) -> np.ndarray:
    """Small letters for A-Z and for the capitals from U+00C0 to U+00DE."""
    data = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, int)
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    data[after] += 0x20
    return data


class Words:
    """The words of some texts, one after the other.

    A plain text's words are runs of bytes that are no white space; if terms is true, runs of letters and digits, in
    small letters.

    data: the texts' bytes; h: a hash for each word; start, end: its place in data; off: text i has the words off[i] to
    off[i + 1] - 1; at: text i has the bytes at[i] to at[i + 1] - 1.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False, terms: bool = False) -> None:
        n = len(data)
        self.data, self.at, self._total = data, at, None
        word = ~(MARKS if terms else SPACE)[data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        edge = at[(at > 0) & (at < n)]
        opens[edge] = word[edge]
        closes[edge - 1] = word[edge - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self._letters = (lambda: lowered(data)) if terms else (lambda: LOWER[data]) if lower else (lambda: data)
        total = _running(VALUES[self._letters()], n)
        spans = (total[self.end] - total[self.start]) * powers(INVERSE, n)[self.start]
        self.h = mix(spans + (self.end - self.start).astype(np.uint64))
        self.off = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.off) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self)), self.counts())

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than size bytes, and the hash of their first size bytes."""
        some = np.flatnonzero(self.end - self.start > size)
        at = self.start[some]
        if self._total is None:
            self._total = _running(VALUES[self._letters()], len(self.data))
        spans = (self._total[at + size] - self._total[at]) * powers(INVERSE, len(self.data))[at]
        return some, mix(spans + np.uint64(size))

    def inside(self, k: int) -> np.ndarray:
        """Which of window_hashes(h, k) lie within one text."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, bool)
        last = np.repeat(self.off[1:], self.counts())
        return np.arange(n) + k <= last[:n]

    def of(self, i: int) -> np.ndarray:
        return self.h[self.off[i] : self.off[i + 1]]

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Text i's words, or those marked in keep, joined by one space."""
        a, b = self.off[i], self.off[i + 1]
        raw = self.data[self.at[i] : self.at[i + 1]].tobytes().split()
        return b" ".join(raw if keep is None else [raw[j] for j in np.flatnonzero(keep[: b - a])])


def slices(
    column: pa.Array | pa.ChunkedArray, lower: bool = False, terms: bool = False, size: int | None = None
) -> Iterator[tuple[int, Words]]:
    """Runs of texts of about `size` bytes (SLICE_BYTES), with the place of their first; a null counts as empty."""
    size = SLICE_BYTES if size is None else size
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, Words(data[at[first] : at[last]], at[first : last + 1] - at[first], lower, terms)
        first = last


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts' bytes; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def signed(h: np.ndarray) -> np.ndarray:
    """Hashes as Spark's longs."""
    return h.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of lists from their entries, one list after the other, and their lengths."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
