"""Texts of Arrow batches as numpy arrays: slices, words, hashes, shingles.

A word is a maximal run of bytes other than space and \\t..\\r. All of these
are ASCII, so words can be found in the UTF-8 bytes. Hashes are 64-bit
polynomials over a fixed byte table, so the hash of any span comes from two
prefix sums.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=_U)
_inverses = np.ones(1, dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 16)
        _powers, _inverses = (np.full(n, b, dtype=_U) for b in (_BASE, _UNBASE))
        _powers[0] = _inverses[0] = 1
        _powers, _inverses = np.cumprod(_powers, dtype=_U), np.cumprod(_inverses, dtype=_U)
    return _powers, _inverses


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of codes times the powers of the base, one longer than the codes."""
    powers, _ = _grown(len(codes) + 1)
    out = np.zeros(len(codes) + 1, dtype=_U)
    np.cumsum(codes * powers[: len(codes)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the sequence behind ``sums``."""
    _, inverses = _grown(len(sums))
    return mix((sums[end] - sums[start]) * inverses[start])


def give_back() -> None:
    """Returns what finished work of this process left free to the system.

    A Python worker goes on from stage to stage, and neither malloc nor Arrow's
    pool gives memory back by itself: a worker would hold the most of any stage
    while it loads the tables of the next.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``limit`` bytes of text, one row at least.

    Memory that is free goes back before the first and after the last.
    """
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
    give_back()


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    space = SPACE[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first = np.concatenate([[True], space[:-1]])
    first[inner] = True
    last = np.concatenate([space[1:], [True]])
    last[inner - 1] = True
    return np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1


class Words:
    """Words of the texts of a column: byte spans, hashes and the bounds of each text."""

    def __init__(self, column: pa.Array, lower: bool = False, recode: np.ndarray | None = None):
        self.data, self.offsets = raw(column)
        if lower or recode is not None:
            self.data = (LOWER if recode is None else recode)[self.data]
        self.start, self.end = _edges(self.data, self.offsets)
        #: word positions at which each text begins; one more than texts
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(prefix_sums(BYTE_CODE[self.data]), self.start, self.end)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, by text and hash.

    A text with fewer words than ``size`` has its whole word sequence as one
    shingle, a text without words has none.
    """
    sums = prefix_sums(words.hashes())
    n = np.where(words.count >= size, words.count - size + 1, np.minimum(words.count, 1))
    text = np.repeat(np.arange(len(n)), n)
    begin = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(text))
    h = span_hashes(sums, begin, begin + np.minimum(words.count, size)[text])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def sums_by(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """Sum of the values of each group; ``group`` ascends."""
    total = np.concatenate([np.zeros(1, dtype=values.dtype), np.cumsum(values, dtype=values.dtype)])
    bounds = np.searchsorted(group, np.arange(groups + 1))
    return total[bounds[1:]] - total[bounds[:-1]]
