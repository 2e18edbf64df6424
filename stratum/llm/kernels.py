"""Vectorised numpy kernels over the UTF-8 bytes of many texts at once.

Texts arrive as Arrow string arrays; a chunk is a run of texts whose bytes are
handled together, so that temporary arrays stay small whatever the batch size.
A single text is never cut: a very long one is a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_U = np.uint64

_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
BYTE_VALUE_LOWER = BYTE_VALUE.copy()
BYTE_VALUE_LOWER[65:91] = BYTE_VALUE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_power: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64 (grown on demand)."""
    got = _power.get(base)
    if got is None or len(got) < n + 1:
        size = 1 << max(12, int(n + 1).bit_length())
        full = np.full(size, _U(base))
        full[0] = 1
        got = np.cumprod(full, dtype=np.uint64)
        if size <= 1 << 23:
            _power[base] = got
    return got[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run):
    """A batch function after whose task freed memory is given back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, for work on Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by name; the first one where names repeat."""
    return batch.column(batch.schema.names.index(name))


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the offsets of its texts; null is empty."""
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8) if n else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of about `limit` bytes."""
    buf, off = text_bytes(arr)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a per-byte array over each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def prefix(buf: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; see span_hash."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(values[buf] * powers(_BASE, len(buf))[: len(buf)], out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    return mix((total[end] - total[start]) * powers(_BASE_INV, len(total))[start])


class Words:
    """Word spans of a chunk: maximal runs of bytes other than 20 and 09-0D."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False, hashes: bool = True):
        solid = ~IS_SPACE[buf]
        n = len(buf)
        first = np.zeros(n + 1, bool)
        first[off] = True
        begin = solid.copy()
        if n:
            begin[1:] &= ~solid[:-1] | first[1:n]
            end = solid.copy()
            end[:-1] &= ~solid[1:] | first[1:n]
        else:
            end = solid
        self.solid, self.buf, self.off = solid, buf, off
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(end) + 1
        cut = np.searchsorted(self.start, off)
        self.first = cut  # word index at which each text begins
        self.count = np.diff(cut)
        if hashes:
            self.total = prefix(buf, BYTE_VALUE_LOWER if lower else BYTE_VALUE)
            self.hash = span_hash(self.total, self.start, self.end)

    def doc(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.count) - np.arange(len(self.start))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of n consecutive word hashes, for each start; the last n - 1 are missing."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out = out * _U(0xD6E8FEB86659FD93) + h[j : j + m]
    return mix(out)


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: whether its value occurs at least twice, and whether it is not the first of its value."""
    n = len(key)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    later = np.zeros(n, bool)
    later[order[1:]] = same
    both = np.zeros(n, bool)
    both[order[1:]] = same
    both[order[:-1]] |= same
    return both, later


def cover(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` words lie in windows of n words that start at `at`."""
    d = np.zeros(total + 1, np.int32)
    d[at] += 1
    np.subtract.at(d, at + n, 1)
    return np.cumsum(d[:-1]) > 0


def shingle_sets(buf: np.ndarray, off: np.ndarray, width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their offsets.

    A text of fewer words than `width` has its whole word sequence as the only
    shingle; one without words has none.
    """
    w = Words(buf, off, lower=lower)
    docs = len(off) - 1
    at = np.flatnonzero(w.left() >= width)
    h = grams(w.hash, width)[at] if len(at) else np.zeros(0, np.uint64)
    d = w.doc()[at]
    short = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k, i in enumerate(short):
            x = w.hash[w.first[i] : w.first[i + 1]]
            whole[k] = grams(x, len(x))[0] ^ _U(len(x) * 0x632BE59BD9B4E019 % 2**64)
        h, d = np.concatenate([h, whole]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(docs + 1))
