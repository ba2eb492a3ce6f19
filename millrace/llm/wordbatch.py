"""Words, hashes and windows of a batch of texts, computed for the whole batch at once.

These helpers run inside mapInArrow tasks on slices of a partition. A null text counts as empty.
Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE_BYTES = 1 << 19
STEP = 0x9E3779B97F4A7C15
STEP_INVERSE = pow(STEP, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: int = STEP) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, and where each of its texts starts (one more at the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text (a longer text is a slice by itself)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = max(int(np.searchsorted(at, at[first] + most, "right")) - 1, first + 1)
            yield batch.slice(first, last - first)
            first = last


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans are in order, apart and not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    first = np.cumsum(length) - length
    offset = np.arange(int(length.sum())) - np.repeat(first, length)
    value = _BYTE[data[offset + np.repeat(start, length)]] * powers(int(length.max()))[offset]
    return mix(np.add.reduceat(value, first) + length.astype(np.uint64))


class Words:
    """Maximal runs of bytes that are not white space, text by text."""

    def __init__(self, column, lower: bool = False):
        self.data, self.at = text_bytes(column)
        if lower:
            self.data = LOWER[self.data]
        self.n_docs = len(self.at) - 1
        inside = ~SPACE[self.data]
        first = np.zeros(len(self.data) + 1, bool)
        first[self.at] = True
        before = np.empty(len(self.data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | first[:-1]))
        after = np.empty(len(self.data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | first[1:])) + 1
        #: words[of[d] : of[d + 1]] are those of text d
        self.of = np.searchsorted(self.start, self.at)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k neighbours in h; windows that cross texts are the caller's to drop."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(n, STEP_INVERSE))


def within(counts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n windows of k words lie in one text each."""
    doc = np.repeat(np.arange(len(counts)), counts)
    return doc[:n] == doc[k - 1 : k - 1 + n] if n > 0 else np.zeros(0, bool)


def leftmost_minimum(h: np.ndarray, k: int) -> np.ndarray:
    """For each window of k entries, the place of its least one (the first of equals)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, width = np.arange(len(h)), 1
    while width < k:
        step = min(width, k - width)
        a, b = best[:-step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        width += step
    return best[:n]


def per_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of flags in each at[d] .. at[d + 1]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def strings(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
