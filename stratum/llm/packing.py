"""Packing token sequences by minimum bin slack.

Lengths run from 1 to `capacity`, so the corpus enters the search only as a
histogram of at most `capacity` counts. On it, minimum bin slack is exact to its
definition: the largest length left opens a bin, a bitset subset-sum over the
lengths available finds the fullest combination for the rest of it, and that
combination is removed as many times as the counts allow. After each step some
length has fewer pieces left than the combination used, so there are at most
capacity * H(capacity) combinations (37,000 for 4096) whatever the corpus: that is
the proven size of the plan which every task gets.

A piece finds its place by its rank among the pieces of its length: its rank
within its task plus the counts of the tasks before. No length, however common,
gathers in one task.

Defined results: a null text is empty and has only the end token; an empty table
gives an empty result; rows that repeat, or have a null id, are packed each on
their own; extra columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .storage import saved

CAPACITY = 4096
END_ID = 1


_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?*%&$#")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def segments(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words, with up to three closing marks after a letter or digit apart."""
    s, e, buf = w.start, w.end.copy(), w.buf
    if not len(s):
        return s, e
    for _ in range(3):
        e -= (e - s > 1) & _TAIL[buf[e - 1]]
    last = buf[e - 1]
    latin = (buf[np.maximum(e - 2, 0)] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (e - s > 1)
    cut = np.flatnonzero((e < w.end) & (_PLAIN[last] | latin))
    begin = np.insert(s, cut + 1, e[cut])
    end = np.insert(w.end, cut, e[cut])
    return begin, end


class WordCache:
    """Token ids of white-space separated words, in sorted arrays of bounded size.

    The tokenizers supported here lower-case, drop ASCII white space and never
    merge letters or digits with the marks after them, so a text's ids are those
    of its words, without regard to the case of A-Z, and of their closing marks.
    Words are known by a 64-bit hash together with their length and first bytes.
    """

    MARK = "\x01"  # encoded between words, so that many words take one call

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        alone = self.tokenizer.encode(f"a {self.MARK} a", add_special_tokens=False).ids
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        if ids("Some Words, here.") != [i for x in ("some", "words", ",", "here", ".") for i in ids(x)]:
            raise ValueError("this tokenizer does not treat words one by one, whatever their case")
        self.mark = mark[0] if len(mark) == 1 and alone.count(mark[0]) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.again = np.zeros(0, np.uint8)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def fresh(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of words."""
        if self.mark is None or any(self.MARK in w for w in words):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return np.fromiter((y for x in ids for y in x), np.uint32, sum(map(len, ids))), np.array([len(x) for x in ids], np.int64)
        texts = [f" {self.MARK} ".join([*words[i : i + 64], ""]) for i in range(0, len(words), 64)]
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(flat == self.mark)
        assert len(ends) == len(words)
        return np.delete(flat, ends), np.diff(np.r_[-1, ends]) - 1

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are known, and where those are."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = (self.key[at] == key) & (self.check[at] == check)
        return known, at[known]

    def shrink(self, at: np.ndarray) -> None:
        """Keep the words that were met again since they came, or only those at `at` where that is too many."""
        keep = self.again > 0
        if keep.sum() > self.most // 2:
            keep = np.zeros(len(self.key), bool)
            keep[at] = True
        start, size = self.start[keep], self.size[keep].astype(np.int64)
        ends = np.cumsum(size)
        pool = self.pool[np.repeat(start - ends + size, size) + np.arange(size.sum())]
        self.key, self.check, self.size = self.key[keep], self.check[keep], self.size[keep]
        self.start, self.again = ends - size, np.zeros(len(size), np.uint8)
        self.pool = np.zeros(max(1 << 16, 2 * len(pool)), np.uint32)
        self.pool[: len(pool)] = pool
        self.used = len(pool)

    def places(self, key: np.ndarray, check: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes in the pool of distinct words in key order; word(k) gives the k-th as text."""
        known, at = self.find(key, check)
        self.again[at] = 1
        new = np.flatnonzero(~known)
        if len(new) and len(self.key) + len(new) > self.most:
            self.shrink(at)
            known, at = self.find(key, check)
            new = np.flatnonzero(~known)
        start, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        start[known], size[known] = self.start[at], self.size[at]
        if len(new):
            flat, n = self.fresh([word(k) for k in new.tolist()])
            while self.used + len(flat) > len(self.pool):
                self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
            self.pool[self.used : self.used + len(flat)] = flat
            start[new], size[new] = self.used + np.cumsum(n) - n, n
            self.used += len(flat)
            where = np.searchsorted(self.key, key[new])
            self.key, self.check = np.insert(self.key, where, key[new]), np.insert(self.check, where, check[new])
            self.start, self.size = np.insert(self.start, where, start[new]), np.insert(self.size, where, n.astype(np.int32))
            self.again = np.insert(self.again, where, np.uint8(0))
        return start, size

    def encode(self, buf: np.ndarray, off: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, each followed by end_id, and their offsets."""
        data = buf.tobytes()
        w = K.Words(buf, off, hashes=False)
        start, end = segments(w)
        # special tokens are spelt in lower case: where one may stand, case counts
        total = K.prefix(buf, K.BYTE_VALUE if b"<|" in data else K.BYTE_VALUE_LOWER)
        key, first, inverse = np.unique(K.span_hash(total, start, end), return_index=True, return_inverse=True)
        s, e = start[first], end[first]
        check = (e - s).astype(np.uint64)
        for j in range(4):
            check = check << np.uint64(8) | np.where(s + j < e, buf[np.minimum(s + j, max(len(buf) - 1, 0))] | 32, 0).astype(np.uint64) if len(s) else check
        begin, size = self.places(key, check, lambda k: data[s[k] : e[k]].decode("utf-8", "replace"))
        begin, size = begin[inverse], size[inverse]
        total = np.r_[0, np.cumsum(size)].astype(np.int64)
        flat = self.pool[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
        at = total[np.searchsorted(start, off)]
        if end_id is None:
            return flat, at
        return np.insert(flat, at[1:], np.uint32(end_id)), at + np.arange(len(at))


_caches: dict[str, WordCache] = {}


def cached(path: str) -> WordCache:
    """The worker's cache for one tokenizer: it outlives tasks, some 50 MB at most."""
    if path not in _caches:
        _caches.clear()
        _caches[path] = WordCache(path)
    return _caches[path]


def fill(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations [(length, how many), ...], each with the number of bins that get it.

    Minimum bin slack with the largest length fixed; larger lengths are tried
    first, so that small ones are left to fill later bins.
    """
    left = {x: n for x, n in counts.items() if n > 0}
    order = sorted(left, reverse=True)
    done = []
    while order:
        top = order[0]
        room = capacity - top
        reach, steps, full = 1, [], 1 << room
        mask = (1 << (room + 1)) - 1
        for x in order:
            if x > room or reach & full:
                continue
            have, size = min(left[x] - (x == top), room // x), 1
            while have > 0 and not reach & full:
                size = min(size, have)
                steps.append((x, size, reach))
                reach = (reach | reach << x * size) & mask
                have -= size
                size *= 2
        used = {top: 1}
        at = reach.bit_length() - 1
        for x, size, before in reversed(steps):
            if not before >> at & 1:
                used[x] = used.get(x, 0) + size
                at -= x * size
        times = min(left[x] // n for x, n in used.items())
        done.append((sorted(used.items(), reverse=True), times))
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        order = [x for x in order if x in left]
    return done


class Places:
    """Where the r-th piece of each length goes."""

    def __init__(self, plan: list[tuple[list[tuple[int, int]], int]]):
        given: dict[int, int] = {}
        rows, bins = [], 0
        for items, times in plan:
            at = 0
            for x, n in items:
                rows.append((x << 48 | given.get(x, 0), given.get(x, 0), n, bins, at))
                given[x] = given.get(x, 0) + n * times
                at += x * n
            bins += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key, self.rank, self.n, self.base, self.at = table.T
        self.bins = bins

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, length << 48 | rank, "right") - 1
        q = rank - self.rank[k]
        return self.base[k] + q // self.n[k], self.at[k] + q % self.n[k] * length


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, part = cached(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for i, j, buf, off in K.chunks(b.column(1), 2 * K.CHUNK_BYTES):
                ids, at = cache.encode(buf, off, end_id)
                size = np.diff(at)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                begin = at[doc] + start
                data = ids.astype("<u4").tobytes()
                crc = np.array([zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(begin.tolist(), (begin + length).tolist(), strict=True)], np.int64)
                order = np.argsort(length, kind="stable")
                sorted_length = length[order]
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.searchsorted(sorted_length, sorted_length) + seen[sorted_length]
                seen += np.bincount(length, minlength=capacity + 1)
                out = [b.column(0).slice(i, j - i).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"]
                if with_ids:
                    out.append(pa.array([data[4 * s : 4 * e] for s, e in zip(begin.tolist(), (begin + length).tolist(), strict=True)], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def _placed(places: Places, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, at = places.find(K.column(b, "length").to_numpy(), K.column(b, "rank").to_numpy()) if b.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*(K.column(b, n) for n in names), pa.array(seq), pa.array(at)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids as little-endian uint32 where asked for).

    `tokenizer` is the path of a tokenizer file that every executor can read.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    extra = ", ids binary" if with_ids else ""
    pieces = saved(src.mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), f"doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long{extra}"), "pieces")
    counts = saved(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = Places(fill(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets.hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("k"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return ranked.mapInArrow(_placed(places, names), f"doc_id long, piece int, start long, length long, ids_crc32 long{extra}, sequence_id long, offset long")
