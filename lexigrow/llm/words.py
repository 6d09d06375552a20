"""Words of texts as 64-bit hashes, computed for whole Arrow batches with numpy.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. A hash is a polynomial in
the word's bytes modulo 2**64, read off running sums over the batch, then mixed. Equal words
have equal hashes everywhere, so hashes serve as names without a dictionary.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that one numpy step works on; a longer text is a step of its own.
SLICE = 1 << 20
#: Rows that are converted at once.
ROWS = 4096

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to at least n - 1 of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE)
        for k, base in enumerate((BASE, INVERSE)):
            row = np.full(size, base, dtype=U)
            row[0] = 1
            _powers[k] = np.multiply.accumulate(row)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple]:
    """``(first row, row after the last, bytes, offsets)`` for runs of rows of a string column.

    A null text counts as empty. A run has at most ``limit`` bytes, or is one longer text.
    """
    for low in range(0, len(column), ROWS):
        part = pc.cast(column.slice(low, ROWS), pa.large_binary())
        if part.null_count:
            part = pc.fill_null(part, b"")
        rows = len(part)
        offsets = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + rows + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        start = 0
        while start < rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(rows, max(start + 1, stop))
            first = offsets[start]
            yield low + start, low + stop, data[first : offsets[stop]], offsets[start : stop + 1] - first
            start = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends of all words, and each text's first word (one entry more than texts)."""
    n = len(data)
    if not n:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(len(offsets), dtype=np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    edge[0] = edge[n] = True
    opens, closes = edge[:-1].copy(), edge[1:].copy()
    opens[1:] |= space[:-1]
    closes[:-1] |= space[1:]
    word = ~space
    starts = np.flatnonzero(word & opens)
    ends = np.flatnonzero(word & closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each byte range; ranges come in order and do not overlap."""
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        low, high = starts[i], ends[i:j].max()
        power, inverse = powers(high - low + 1)
        total = np.zeros(high - low + 1, dtype=U)
        terms = data[low:high].astype(U)
        terms += U(1)
        terms *= power[: high - low]
        np.cumsum(terms, out=total[1:])
        first, last = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (total[last] - total[first]) * inverse[first]
        i = j
    out ^= (ends - starts).astype(U) * U(0xD6E8FEB86659FD93)
    return mix(out)


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, ...]:
    """Word hashes and each text's first word; ``lower`` maps A-Z to a-z before."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(LOWER[data] if lower else data, starts, ends), first


def give_back() -> None:
    """Returns freed memory of this worker to the system. Workers live on between tasks, and
    what they hold on to counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over batches that gives memory back when its task ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
