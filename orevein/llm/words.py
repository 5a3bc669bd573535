"""Vectorised hashing of words and shingles, straight from Arrow string buffers.

A word is a run of bytes other than ASCII white space; ASCII letters count in lower case. Word
hashes come from prefix sums of a polynomial over the bytes, so no Python string is made. Texts are
cut into slices of about ``SLICE`` bytes (a longer text is a slice of its own), which bounds memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (the finaliser of splitmix64)."""
    x = np.array(x, np.uint64)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    size = max(SLICE * 2, 1 << max(0, n - 1).bit_length())
    return _powers(size, _INVERSE if inverse else _BASE)[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null as empty) and their ``n + 1`` offsets."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def trim() -> None:
    """Give freed memory back to the system: a worker serves tasks of many kinds, and an executor counts what all of them hold."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, last, bytes, offsets`` of consecutive texts of about ``size`` bytes together."""
    raw, ends = buffers(texts)
    first, n = 0, len(ends) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, side="right")) - 1)
        yield first, last, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last
    trim()


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses a text's edge."""
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    stops[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans ``[start, stop)``."""
    n = len(raw)
    if n == 0 or len(starts) == 0:
        return np.zeros(0, np.uint64)
    x = (_LOWER[raw] if lower else raw.astype(np.uint64) + np.uint64(1)) * powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return mix((total[stops] - total[starts]) * powers(n, inverse=True)[starts])


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the offset of its first word (``n + 1`` offsets)."""
    starts, stops = word_spans(raw, ends)
    return span_hashes(raw, starts, stops), np.searchsorted(starts, ends).astype(np.int64)


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each ``n`` neighbouring entries (``len - n + 1`` of them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    factor = np.uint64(_BASE)
    for k in range(n):
        out = out * factor + hashes[k : k + m]
    return mix(out)


def ragged(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``concat(arange(first, first + count))`` over all pairs."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.repeat(firsts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total, dtype=np.int64) + shift


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``n``-word shingles and their offsets; a text of 1 to ``n - 1`` words has one, of all its words."""
    counts = np.diff(offsets)
    full = np.maximum(counts - n + 1, 0)
    chained = chain(hashes, n)
    out_counts = np.where(full > 0, full, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(out_counts)]).astype(np.int64)
    out = np.zeros(int(out_offsets[-1]), np.uint64)
    where = ragged(out_offsets[:-1][full > 0], full[full > 0])
    out[where] = chained[ragged(offsets[:-1][full > 0], full[full > 0])]
    for i in np.flatnonzero((full == 0) & (counts > 0)):
        h = hashes[offsets[i] : offsets[i + 1]]
        out[out_offsets[i]] = chain(h, len(h))[0] + np.uint64(len(h))
    return out, out_offsets


class Recent:
    """Tells items that a task has just seen from others, in constant memory: a repeat may be missed, a new item never is."""

    def __init__(self, slots: int = 1 << 16):
        self.table, self.mask = np.zeros(slots, np.uint64), np.uint64(slots - 1)

    def fresh(self, items: np.ndarray) -> np.ndarray:
        """Which of the distinct, non-zero ``items`` aren't known as repeats."""
        slot = items & self.mask
        out = self.table[slot] != items
        self.table[slot] = items
        return out


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring offsets, each by itself: it doesn't depend on what stands beside it."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        out[some] = np.add.reduceat(values, offsets[:-1][some])
    return out


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
