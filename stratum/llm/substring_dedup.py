"""Removal of passages that repeat across documents, by paragraph MinHash banding.

1. Paragraphs are the lines of the texts. Equal ones (A-Z lower-cased words) are
   one class, found by a pre-aggregated grouping.
2. A class has `bands` MinHash values of its five-word shingles, each a band of
   its own: a pair of similarity 0.8 collides with probability 1 - 0.2 ** bands,
   0.992 for three. Colliding classes are verified by exact Jaccard on their
   full shingle sets, in pieces of bounded size; the members of keys beyond one
   piece are first compared with a few of them, which settles groups of near copies
   in linear time.
3. Verified classes are clustered by connected components; of each cluster only
   the first occurrence (least document, then place) stays.
4. For passages inside lines, 1 to 3 are done once more with smaller units in
   what the paragraphs leave: every text is cut into pieces of 7 words or more
   (about 13) at places that depend only on the six words to either side: line
   starts first, then sentence starts, then any word, the least hash within reach
   deciding. A passage therefore gets the same inner pieces wherever it stands,
   also in the middle of another text's line. Pieces in removed paragraphs are
   not counted, so that no passage goes for the sake of one that goes itself.
5. A run of adjoining removed words is extended at both ends, word by word, as far
   as it goes on like the occurrence that stays: from the pieces that a passage
   has everywhere to its exact borders. These lie within the piece beside the run
   and `reach` words more, so that only so many words are compared.
6. Extended runs of fewer than `min_words` words are left alone, so that a repeated
   phrase or stock sentence does not damage a text.

`WHOLE`, the default, does all of this; a Plan without `paragraphs` only compares
the pieces of step 4, and extends them.

Defined results: null and empty texts have no units; very long texts are read
whole; rows without an id take no part and stay as they are; equal rows of one id
are one document and lose nothing to each other; different texts of one id are
documents of their own, in no given order; of equal occurrences that of the least
id, then of the first word, stays; an empty table gives no spans; extra columns,
whatever their names, are not read and are kept by `cut`. A text shorter than five
words has its whole word sequence as its only shingle. Words are compared by 64-bit
hashes of their bytes, shingles by hashes of these; the hash is not cryptographic,
so texts made for the purpose could collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from . import kernels as K
from .columns import fields, plain, with_text
from .components import components
from .near_dedup import _runs, alike_sets, in_pieces, linked, settled, split_hot, spread
from .sieve import passes, sieve
from .storage import mark, saved

_U = np.uint64


@dataclass(frozen=True)
class Plan:
    width: int = 5
    percent: int = 80
    bands: int = 3
    reach: int = 6
    min_words: int = 20
    piece: int = 128
    hot_sample: int = 1024
    hot_least: int = 8
    paragraphs: bool = False
    extend: bool = True


WHOLE = Plan(paragraphs=True)

_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def line_starts(w: K.Words) -> np.ndarray:
    """Which words have a line feed between them and the word before."""
    feeds = np.zeros(len(w.buf) + 1, np.int32)
    np.cumsum(w.buf == 10, out=feeds[1:])
    line = np.zeros(len(w.start), bool)
    line[1:] = feeds[w.start[1:]] != feeds[w.end[:-1]]
    return line


def lines(w: K.Words) -> np.ndarray:
    """Word indices at which lines begin, each text's first word included."""
    line = line_starts(w)
    line[w.first[:-1][w.count > 0]] = True
    return np.flatnonzero(line)


def starts(w: K.Words, plan: Plan, whole: bool) -> np.ndarray:
    return lines(w) if whole else cuts(w, plan.reach)


def cuts(w: K.Words, reach: int) -> np.ndarray:
    """Word indices at which pieces begin, each text's first word included."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64)
    first = w.buf[w.start]
    second = w.buf[np.minimum(w.start + 1, len(w.buf) - 1)]
    # capitals beyond A-Z that UTF-8 writes as C3 80 to C3 9E
    upper = _UPPER[first] | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    after_end = np.zeros(n, bool)
    after_end[1:] = _ENDS[w.buf[w.end[:-1] - 1]]
    line = line_starts(w)
    line[w.first[:-1][w.count > 0]] = True  # whatever text stands before in the batch
    rank = np.where(line, 0, np.where(after_end | upper, 1, 2)).astype(np.uint64)
    follow = np.r_[w.hash[1:], w.hash[:1]]
    follow[w.first[1:][w.count > 0] - 1] = 0  # a text's last word has none after it
    value = (rank << _U(62)) | (K.mix(w.hash * _U(0xD6E8FEB86659FD93) + follow) >> _U(2))
    # least value within reach, by doubling; texts are kept apart by padding
    docs = len(w.count)
    at = np.arange(n) + np.repeat(np.arange(docs) * 2 * reach, w.count) + reach
    most = _U(2**64 - 1)
    size = n + 2 * reach * docs + 2 * reach
    padded = np.full(size, most)
    padded[at] = value

    def ahead(x: np.ndarray, width: int) -> np.ndarray:
        """Minimum of x[i : i + width]."""
        got, have = x, 1
        while have < width:
            step = min(have, width - have)
            got = np.minimum(got, np.r_[got[step:], np.full(step, most)])
            have += step
        return got

    small = ahead(padded, reach)
    before = small[at - reach]
    after = small[at + 1]
    cut = (value < before) & (value <= after)
    cut[w.first[:-1][w.count > 0]] = True
    return np.flatnonzero(cut)


def sequence(w: K.Words, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of words."""
    total = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * K.powers(K._BASE, len(w.hash))[: len(w.hash)], out=total[1:])
    raw = (total[end] - total[begin]) * K.powers(K._BASE_INV, len(total))[begin]
    ends = K.mix(w.hash[begin]) ^ (K.mix(w.hash[end - 1]) * _U(3)) ^ raw
    return K.mix(raw), (K.mix(ends + (end - begin).astype(np.uint64)) >> _U(33)).astype(np.int32)


def shingled(w: K.Words, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each run of words (with repeats) and their offsets; a shorter run is one shingle."""
    g = K.grams(w.hash, width)
    count = np.maximum(end - begin - width + 1, 1)
    at = np.r_[0, np.cumsum(count)]
    where = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(begin, count)
    short = np.flatnonzero(end - begin < width)
    if len(short):
        where[at[short]] = 0
    h = g[where] if len(g) else np.zeros(len(where), np.uint64)
    if len(short):
        h[at[short]] = sequence(w, begin[short], end[short])[0]
    return h, at


def minima(h: np.ndarray, at: np.ndarray, bands: int) -> list[np.ndarray]:
    r = np.random.default_rng(11)
    out = []
    for j, a in enumerate(r.integers(1, 2**63, bands, dtype=np.uint64) * _U(2) + _U(1)):
        x = h * a
        x ^= x >> _U(32)
        out.append(K.mix(np.minimum.reduceat(x, at[:-1]) + _U(j)).view(np.int64))
    return out


def _skipped(w: K.Words, skips: list) -> np.ndarray:
    """Running counts of words in their text's skipped ranges."""
    gone = np.zeros(len(w.start) + 1, np.int64)
    for d, skip in enumerate(skips):
        for x in skip or ():
            gone[w.first[d] + x["begin"] : min(w.first[d] + x["stop"], w.first[d + 1])] = 1
    return np.r_[0, np.cumsum(gone)]


def code_points(buf: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=points[1:])
    return points


_PLACES = 1 << 24


def _units(plan: Plan, place: bool, whole: bool, wanted=None, packed: bool = False):
    """Unit rows (lines if `whole`, else pieces): with place, where each stands that the sieve `wanted` lets through; else its band keys (packed: id and place in one long)."""

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, copies = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j, buf, off in K.chunks(b.column(2)):
                w = K.Words(buf, off, lower=True)
                begin = starts(w, plan, whole)
                if not len(begin):
                    continue
                end = np.r_[begin[1:], len(w.start)]
                doc = np.searchsorted(w.first, begin, "right") - 1
                if b.num_columns > 3 and b.column(3).slice(i, j - i).null_count < j - i:
                    total = _skipped(w, b.column(3).slice(i, j - i).to_pylist())
                    stay = np.flatnonzero(total[end] == total[begin])
                    if not len(stay):
                        continue
                    begin, end, doc = begin[stay], end[stay], doc[stay]
                f1, f2 = sequence(w, begin, end)
                if place:
                    pick = np.flatnonzero(passes(wanted.value, f1))
                    if not len(pick):
                        continue
                    f1, f2, begin, end, doc = (x[pick] for x in (f1, f2, begin, end, doc))
                out = {"f1": pa.array(f1.view(np.int64)), "f2": pa.array(f2)}
                if packed:
                    out |= {"first": pa.array(ids[i:j][doc].astype(np.int64) * _PLACES + begin - w.first[doc]), "words": pa.array((end - begin).astype(np.int32))}
                else:
                    out |= {"doc_id": pa.array(ids[i:j][doc].astype(np.int64)), "copy": pa.array(copies[i:j][doc].astype(np.int64))}
                    out |= {"begin": pa.array((begin - w.first[doc]).astype(np.int32)), "stop": pa.array((end - w.first[doc]).astype(np.int32))}
                if place:
                    points = code_points(buf)
                    base = points[off[doc]]
                    out |= {"start": pa.array(points[w.start[begin]] - base), "end": pa.array(points[w.end[end - 1]] - base)}
                else:
                    h, at = shingled(w, begin, end, plan.width)
                    out |= {f"k{n}": pa.array(k) for n, k in enumerate(minima(h, at, plan.bands))}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _binaries(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """The bytes of `count` values each."""
    at = np.r_[0, np.cumsum(count)].astype(np.int64) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(at), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def _unit_sets(plan: Plan, whole: bool):
    """(text, wanted units) to these units' hashes, words and shingle sets."""

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = np.r_[0, np.cumsum(b.column(1).value_lengths().to_numpy())]
            rows = b.column(1).flatten()
            node, begins = (rows.field(k).to_numpy().astype(np.int64) for k in ("node", "begin"))
            for i, j, buf, off in K.chunks(b.column(0)):
                here = slice(first[i], first[j])
                if first[i] == first[j]:
                    continue
                w = K.Words(buf, off, lower=True)
                begin = np.repeat(w.first[:-1], np.diff(first[i : j + 1])) + begins[here]
                cut = starts(w, plan, whole)
                end = np.r_[cut, len(w.start)][np.searchsorted(cut, begin, "right")]
                f1, f2 = sequence(w, begin, end)
                h, at = shingled(w, begin, end, plan.width)
                unit = np.repeat(np.arange(len(at) - 1), np.diff(at))
                order = np.lexsort((h, unit))
                h, unit = h[order], unit[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (unit[1:] != unit[:-1])]
                h, at = h[new], np.searchsorted(unit[new], np.arange(len(at)))
                out = [pa.array(node[here]), pa.array(f1.view(np.int64)), pa.array(f2), pa.array((end - begin).astype(np.int32)), _binaries(h, np.diff(at))]
                yield pa.RecordBatch.from_arrays(out, names=["node", "f1", "f2", "words", "shingles"])

    return run


_FEW = 8  # members of a group of which all pairs are compared


def _verify(plan: Plan):
    """Verified pairs among the members of a piece: all of a few, else a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = b.column(0).value_lengths().to_numpy()
            begin = np.r_[0, np.cumsum(count)]
            members = b.column(0).flatten()
            node = members.field("node").to_numpy()
            flat, ends = _set_values(members.field("shingles"))
            size = np.diff(ends)
            left, right = [], []
            for k in range(2, _FEW + 1):  # all pairs of small groups at once
                some = begin[:-1][count == k]
                for x, y in combinations(range(k), 2):
                    for at in range(0, len(some), 4096):
                        a, c = some[at : at + 4096] + x, some[at : at + 4096] + y
                        hit = _alike(flat, ends, a, c, plan.percent)
                        left.append(node[a[hit]])
                        right.append(node[c[hit]])
            for g in np.flatnonzero(count > _FEW):
                m, n = begin[g], begin[g + 1]
                sizes = size[m:n]
                near = linked(_shared(flat[ends[m] : ends[n]], sizes), sizes[:, None], sizes[None, :], plan.percent)
                pairs = np.array(spread(n - m, lambda x, rest, near=near: near[x][rest]), np.int64).reshape(-1, 2) + m
                left.append(node[pairs[:, 0]])
                right.append(node[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, node[:0]]), pa.int64()) for x in (left, right)], names=["a", "b"])

    return run


def _set_values(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of an array of sets, and where each set begins."""
    sets = sets.cast(pa.large_binary())
    n, (_, off, data) = len(sets), sets.buffers()
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    at = np.frombuffer(off, np.int64, n + 1, sets.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint64), (at - at[0]) // 8


def _within(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values stand in flat[begin:end], a sorted stretch for each of them, by binary search."""
    low, high = begin.copy(), end.copy()
    for _ in range(int((end - begin).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        less = (flat[np.minimum(mid, len(flat) - 1)] < values) & (low < high)
        np.copyto(low, mid + 1, where=less)
        np.copyto(high, mid, where=~less)
    return (low < end) & (flat[np.minimum(low, len(flat) - 1)] == values)


def _alike(flat: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of `a` are linked with that of `b`; only those are read in full that share one of so many first values that a linked pair cannot miss them all."""
    size = np.diff(ends)
    a, b = np.where(size[a] <= size[b], a, b), np.where(size[a] <= size[b], b, a)
    need = -(-percent * (size[a] + size[b]) // (100 + percent))  # shared values of a linked pair

    def shared(pick: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """How many of `count` values of a, from place `first` on, are in b."""
        pair = np.repeat(np.arange(len(pick)), count)
        at = np.arange(len(pair)) + np.repeat(ends[a[pick]] + first - (np.cumsum(count) - count), count)
        other = b[pick][pair]
        return np.bincount(pair[_within(flat, ends[other], ends[other + 1], flat[at])], minlength=len(pick))

    pick = np.flatnonzero(need <= size[a])
    lead = size[a[pick]] - need[pick] + 1
    inter = shared(pick, np.zeros_like(lead), lead)
    pick, lead, inter = pick[inter > 0], lead[inter > 0], inter[inter > 0]
    inter = inter + shared(pick, lead, size[a[pick]] - lead)
    hit = np.zeros(len(a), bool)
    hit[pick] = linked(inter, size[a[pick]], size[b[pick]], percent)
    return hit


_DENSE = 1 << 21  # cells of a table of sets by values


def _shared(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many values each two of some sets share, with tables of so many cells at a time as products of floats are exact for."""
    order, n = np.argsort(flat), len(sizes)
    values, who = flat[order], np.repeat(np.arange(n), sizes)[order]
    code = np.cumsum(np.r_[False, values[1:] != values[:-1]])
    out, step = np.zeros((n, n), np.int64), max(64, _DENSE // n)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        i, j = np.searchsorted(code, (at, at + step))
        held = np.zeros((n, code[j - 1] - at + 1), np.float32)
        held[who[i:j], code[i:j] - at] = 1
        out += (held @ held.T).astype(np.int64)
    return out


_RARE = 16  # members of a key that may have a value which counts as uncommon


def _tokens(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All values of the sets of (grp, node, data) rows, each mixed with its group, and where each set begins."""
    flat, ends = _set_values(b.column(2))
    return K.mix(flat ^ K.mix(np.repeat(b.column(0).to_numpy().view(np.uint64), np.diff(ends)))), ends


_PARTS = 128  # tables in which values are counted


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, node, data) to (part, keys, counts): how often each value occurs in a batch, by the values' first bits."""
    for b in batches:
        keys, n = np.unique(_tokens(b)[0], return_counts=True)
        sizes = np.bincount((keys >> _U(57)).astype(np.int64), minlength=_PARTS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PARTS), pa.int64()), _binaries(keys, sizes), _binaries(n.astype(np.int64), sizes)], names=["part", "keys", "counts"])


def _over(most: int):
    """Lists of the (keys, counts) of a part to the keys that occur more than `most` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.column(0):
                keys, n = (np.frombuffer(b"".join(x[k].as_py() for x in rows), t) for k, t in (("keys", np.int64), ("counts", np.int64)))
                found, at = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(found[np.bincount(at, n, len(found)) > most])], names=["key"])

    return run


def _leads(tokens: np.ndarray, ends: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The uncommon ones among the first values of each set, as (values, which set), and the sets that have a common one there.

    First come uncommon values, then common ones, either by value; of these, so many
    that a linked pair cannot miss each other's: such a pair shares an uncommon one,
    or each has a common one.
    """
    size = np.diff(ends)
    lead = np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
    of = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((tokens, common, of))
    first = np.arange(len(tokens)) - np.repeat(ends[:-1], size) < np.repeat(lead, size)
    order, of = order[first], of[first]
    rare = ~common[order]
    return tokens[order[rare]], of[rare], np.bincount(of[~rare], minlength=len(size)) > 0


def _uncommon(plan: Plan, common):
    """(grp, node, data) to (key, node): the members by their uncommon first values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches, 2048):
            tokens, ends = _tokens(b)
            keys, of, _ = _leads(tokens, ends, passes(common.value, tokens), plan.percent)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(1).take(pa.array(of))], names=["key", "node"])

    return run


def _alike_at_most(plan: Plan, common):
    """(grp, node, data): those that may be linked with others by common values alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.slices(batches, 2048):
            tokens, ends = _tokens(b)
            yield b.filter(pa.array(_leads(tokens, ends, passes(common.value, tokens), plan.percent)[2]))

    return run


def _hot_keys(many: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Verified pairs within keys of more members than one piece holds.

    Most such keys are phrases in many units that are otherwise unlike, so that their
    pairs are not all compared: linked ones share one of their first values that at most
    `_RARE` of the key's members have, or are both made of what more of them have. The
    latter are near copies; they are compared with a few of them, then in blocks.
    """
    members = saved(many.join(sets.select("node", "shingles"), "node").select(F.col("key").alias("grp"), "node", F.col("shingles").alias("data")), "hot")
    counted = members.mapInArrow(_counted, "part long, keys binary, counts binary").groupBy("part").agg(F.collect_list(F.struct("keys", "counts")).alias("rows"))
    often = counted.select("rows").mapInArrow(_over(min(_RARE, plan.piece)), "key long")
    common = sieve(saved(often, "common"))  # what it lets through besides counts as common, everywhere alike
    rare = members.mapInArrow(_uncommon(plan, common), "key long, node long")
    lists = rare.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(plan.piece), "key long, part int, nodes array<long>")
    groups = saved(lists.select("nodes").where("size(nodes) > 1").distinct().select(F.monotonically_increasing_id().alias("piece"), "nodes"), "pieces")
    full = groups.select("piece", F.explode("nodes").alias("node")).join(sets.select("node", "shingles"), "node").groupBy("piece").agg(F.collect_list(F.struct("node", "shingles")).alias("members"))
    found = full.select("members").mapInArrow(_verify(plan), "a long, b long")

    members = saved(members.mapInArrow(_alike_at_most(plan, common), members.schema), "alike")
    edges, marks = settled(members, alike_sets(plan.percent))
    lists = in_pieces(members, marks, plan.piece).groupBy("grp", "x", "y").agg(F.collect_list(F.struct("node", F.col("data").alias("shingles"))).alias("members"))
    return found.union(edges).union(lists.select("members").mapInArrow(_verify(plan), "a long, b long"))


def _fits(src: DataFrame) -> bool:
    """Whether id and word number of any word fit into one long."""
    low, high, size = src.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))).first()
    return low is None or (low >= 0 and high < (1 << 63) // _PLACES and (size or 0) <= _PLACES)


def _gone(src: DataFrame, plan: Plan, whole: bool, packed: bool, skips: DataFrame | None = None) -> DataFrame:
    """The units to remove, where each stands and what stays (keep: of its first unit, tail: of its last); those that touch `skips` are not counted.

    packed: ids do not repeat, and `_fits` holds.
    """
    begun = mark(src.sparkSession)
    bands = [f"k{n}" for n in range(plan.bands)]
    # the smaller side of these joins is hashed, so that neither texts nor all units are sorted
    counted = src if skips is None else src.join(skips.hint("shuffle_hash"), ["doc_id", "copy"], "left").select("doc_id", "copy", "text", "skip")
    place = "doc_id long, copy long, begin int, stop int"
    keys = ", ".join(f"{k} long" for k in bands)
    rows = counted.mapInArrow(_units(plan, False, whole, packed=packed), f"f1 long, f2 int, {'first long, words int' if packed else place}, {keys}")
    # equal units have equal keys and as many words; Spark groups by hash only what is in columns of fixed length, and sorts for a struct
    least = [F.min("first").alias("node"), F.min("words").alias("words")] if packed else [F.min(F.struct("doc_id", "copy", "begin", "stop")).alias("first")]
    classes = rows.groupBy("f1", "f2").agg(F.count("*").alias("n"), *least, *(F.min(k).alias(k) for k in bands))
    # where ids and places fit into one long, a class is numbered by its first unit, so that nothing need be looked up by number
    classes = saved(classes if packed else classes.withColumn("node", F.monotonically_increasing_id()), "paragraphs")

    def first(df: DataFrame) -> DataFrame:
        """(node, f1, f2, words or first) with the first unit."""
        if packed:
            doc, begin = F.shiftright("node", _PLACES.bit_length() - 1), F.col("node").bitwiseAND(F.lit(_PLACES - 1)).cast("int")
            df = df.withColumn("first", F.struct(doc.alias("doc_id"), F.lit(0).cast("long").alias("copy"), begin.alias("begin"), (begin + F.col("words")).alias("stop")))
        return df.select("node", "first", "f1", "f2")

    by_band = lambda df: df.select("node", F.explode(F.array(*bands)).alias("key")).select("key", "node")
    keyed_from = mark(src.sparkSession)
    keyed, hot = split_hot(classes, by_band, plan.hot_sample, plan.hot_least)
    lists = saved(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_runs(plan.piece), "key long, part int, nodes array<long>"), "collisions")
    large = lists.where("part > 0").select("key").distinct()  # keys beyond one piece
    groups = lists.join(large, "key", "left_anti").select("nodes").where("size(nodes) > 1").distinct()
    members = saved(groups.select(F.monotonically_increasing_id().alias("piece"), "nodes"), "pieces").select("piece", F.explode("nodes").alias("node"))
    many = lists.join(large, "key", "left_semi").select("key", F.explode("nodes").alias("node"))
    many = (many if hot is None else many.union(hot)).distinct()

    hit = members.select("node").union(many.select("node")).distinct()
    if packed:
        hit = first(hit.select("node", *(F.lit(0).alias(c) for c in ("f1", "f2", "words")))).select("node", "first")
    else:
        hit = classes.select("node", "first", "f1", "f2").join(hit.hint("shuffle_hash"), "node")
    hit = saved(hit, "collided")
    wanted = hit.groupBy("first.doc_id", "first.copy").agg(F.collect_list(F.struct("node", "first.begin")).alias("wanted"))
    sets = src.join(wanted.hint("shuffle_hash"), ["doc_id", "copy"]).select("text", "wanted")
    sets = saved(sets.mapInArrow(_unit_sets(plan, whole), "node long, f1 long, f2 int, words int, shingles binary"), "sets")
    full = members.join(sets.select("node", "shingles"), "node").groupBy("piece").agg(F.collect_list(F.struct("node", "shingles")).alias("members"))
    found = full.select("members").mapInArrow(_verify(plan), "a long, b long")
    same = saved(components(found.union(_hot_keys(many, sets, plan))), "same", since=keyed_from, keep=(sets if packed else hit,))

    near = first(sets if packed else hit).join(same, "node")
    exact = first(classes.where("n > 1")).join(same.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    cluster = saved(exact.unionByName(near).dropDuplicates(["node"]), "clusters", since=begun)
    keep = cluster.groupBy("component").agg(F.min("first").alias("keep"))
    known = cluster.join(keep, "component").select("f1", "f2", "keep")
    placed = src.mapInArrow(_units(plan, True, whole, sieve(cluster.select("f1"))), f"f1 long, f2 int, {place}, start long, end long")
    gone = placed.join(known.hint("shuffle_hash"), ["f1", "f2"]).where("not (doc_id = keep.doc_id and copy = keep.copy and begin = keep.begin)")
    gone = gone.groupBy("doc_id", "copy", "begin").agg(*(F.min(c).alias(c) for c in ("start", "keep")), *(F.max(c).alias(c) for c in ("end", "stop")))
    # nodes are numbered anew in each run; a cluster is named by what stays of it
    return gone.select("doc_id", "copy", "start", "end", "begin", "stop", "keep", F.col("keep").alias("tail"), F.xxhash64("keep", F.lit(whole)).alias("component"))


def _spans(gone: DataFrame, least: int) -> DataFrame:
    """Adjoining ranges of words as one, if they have `least` words."""
    by_place = Window.partitionBy("doc_id", "copy").orderBy("begin", "stop", "keep", "tail", "component")
    reached = F.max("stop").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opens = gone.withColumn("opens", F.when(F.col("begin") <= reached, 0).otherwise(1))
    runs = opens.withColumn("run", F.sum("opens").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.min(F.struct("begin", "stop", "keep", "component")), F.max(F.struct("stop", "begin", "tail"))
    spans = runs.groupBy("doc_id", "copy", "run").agg(*(F.min(c).alias(c) for c in ("start", "begin")), *(F.max(c).alias(c) for c in ("end", "stop")), first.alias("first"), last.alias("last"))
    return spans.where(F.col("stop") - F.col("begin") >= least).select("doc_id", "copy", "start", "end", "begin", "stop", "first.keep", "last.tail", "first.component")


_SIDE = "doc_id long, copy long, at int, back boolean, words binary, points binary, like struct<doc_id:long,copy:long,at:int>, room int"


def _sides(plan: Plan):
    """(doc_id, copy, text, skip, asked): the words before or after each place asked for, and where they stand, as far as a border can lie."""

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            skips, first = b.column(3).to_pylist(), np.r_[0, np.cumsum(b.column(4).value_lengths().to_numpy())]
            asked = b.column(4).flatten()
            for i, j, buf, off in K.chunks(b.column(2)):
                if first[i] == first[j]:
                    continue
                some = asked.slice(first[i], first[j] - first[i])
                at, back = some.field("at").to_numpy(), some.field("back").to_numpy(zero_copy_only=False)
                own = some.field("like").is_valid().to_numpy(zero_copy_only=False)
                w = K.Words(buf, off, lower=True)
                cut, points = cuts(w, plan.reach), code_points(buf)
                gone = np.diff(_skipped(w, skips[i:j])) > 0
                doc = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
                at = w.first[doc] + at
                low = np.maximum(w.first[doc], cut[np.maximum(np.searchsorted(cut, at) - 1, 0)] - plan.reach)
                after = np.r_[cut, len(w.start)][np.searchsorted(cut, at, "right")]
                high = np.minimum(w.first[doc + 1], after + plan.reach)
                count = np.maximum(np.where(back, at - low, high - at), 0)
                ask = np.repeat(np.arange(len(at)), count)
                far = np.arange(len(ask)) - np.repeat(np.cumsum(count) - count, count)
                pick = np.where(back[ask], at[ask] - 1 - far, at[ask] + far)
                bad = gone[pick] & ~own[ask]  # what goes itself is no reason to go
                np.minimum.at(count, ask[bad], far[bad])
                stay = far < count[ask]
                ask, pick = ask[stay], pick[stay]
                where = (np.where(back[ask], points[w.start[pick]], points[w.end[pick]]) - points[off[doc[ask]]])[own[ask]]
                rows = pa.array(i + doc)
                out = [b.column(0).take(rows), b.column(1).take(rows), some.field("at"), some.field("back"), _binaries(w.hash[pick], count), _binaries(where.astype(np.int32), np.where(own, count, 0))]
                yield pa.RecordBatch.from_arrays([*out, some.field("like"), some.field("room")], names=["doc_id", "copy", "at", "back", "words", "points", "like", "room"])

    return run


@K.tidied
def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words, and up to which place, two sides agree."""
    for b in batches:
        many, where = [], []
        for mine, theirs, points, room in zip(*(b.column(k).to_pylist() for k in (4, 5, 6, 7)), strict=True):
            p, q = np.frombuffer(mine, np.uint64), np.frombuffer(theirs, np.uint64)
            n = min(len(p), len(q), room)
            k = int(np.argmax(np.r_[p[:n] != q[:n], True]))
            many.append(k)
            where.append(int(np.frombuffer(points, np.int32)[k - 1]) if k else 0)
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(many, pa.int32()), pa.array(where, pa.int64())], names=["doc_id", "copy", "at", "back", "many", "where"])


def _extended(src: DataFrame, gone: DataFrame, plan: Plan, skips: DataFrame | None, begun: int) -> DataFrame:
    """The removed ranges (whose tables were saved since `begun`), and what their runs go on alike with what stays."""
    runs = saved(_spans(gone, 1), "runs", since=begun)
    asked_from = mark(src.sparkSession)
    whole = 2**31 - 1
    own = F.col("keep.doc_id") == F.col("doc_id")
    own = own & (F.col("keep.copy") == F.col("copy")) & (F.col("keep.stop") <= F.col("begin"))
    room = F.when(own, F.col("begin") - F.col("keep.stop")).otherwise(whole)  # an occurrence that stays in the same text is not reached
    like = lambda side, at: F.struct(F.col(f"{side}.doc_id"), F.col(f"{side}.copy"), F.col(f"{side}.{at}").alias("at"))
    left = runs.select("doc_id", "copy", F.col("begin").alias("at"), F.lit(True).alias("back"), like("keep", "begin").alias("like"), room.alias("room"))
    right = runs.select("doc_id", "copy", F.col("stop").alias("at"), F.lit(False).alias("back"), like("tail", "stop").alias("like"), F.lit(whole).alias("room"))
    mine = left.union(right)
    theirs = mine.select("like.*", "back").distinct().select("doc_id", "copy", "at", "back", F.lit(None).cast("struct<doc_id:long,copy:long,at:int>").alias("like"), F.lit(whole).alias("room"))
    asked = mine.union(theirs).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("at", "back", "like", "room")).alias("asked"))
    asked = asked.withColumn("skip", F.lit(None).cast("array<struct<begin:int,stop:int>>")) if skips is None else asked.join(skips.hint("merge"), ["doc_id", "copy"], "left")
    texts = src.join(asked.hint("shuffle_hash"), ["doc_id", "copy"])
    sides = saved(texts.select("doc_id", "copy", "text", "skip", "asked").mapInArrow(_sides(plan), _SIDE), "sides")
    stay = sides.where("like is null").select(F.struct("doc_id", "copy", "at").alias("like"), "back", F.col("words").alias("theirs"))
    both = sides.where("like is not null and length(words) > 0").join(stay.where("length(theirs) > 0").hint("merge"), ["like", "back"])
    found = both.select("doc_id", "copy", "at", "back", "words", "theirs", "points", "room").mapInArrow(_longer, "doc_id long, copy long, at int, back boolean, many int, where long").where("many > 0")
    found = saved(found, "longer", since=asked_from)
    more_left = runs.join(found.where("back").withColumnRenamed("at", "begin"), ["doc_id", "copy", "begin"])
    more_left = more_left.select("doc_id", "copy", F.col("where").alias("start"), F.col("start").alias("end"), (F.col("begin") - F.col("many")).alias("begin"), F.col("begin").alias("stop"), "keep", "tail", "component")
    more_right = runs.join(found.where("not back").withColumnRenamed("at", "stop"), ["doc_id", "copy", "stop"])
    more_right = more_right.select("doc_id", "copy", F.col("end").alias("start"), F.col("where").alias("end"), F.col("stop").alias("begin"), (F.col("stop") + F.col("many")).alias("stop"), "keep", "tail", "component")
    return runs.unionByName(more_left).unionByName(more_right)


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """The rows with doc_id, copy and text, and whether ids repeat: `copy` tells different texts of one id apart, and is 0 where an id does not repeat."""
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *rows.columns)
    twice = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", F.lit(True).alias("twice"))
    twice = saved(twice, "repeated")
    found = twice.count()
    if not found:
        return rows.withColumn("copy", F.lit(0).cast("long")), False
    twice = F.broadcast(twice) if found <= 1_000_000 else twice.hint("merge")  # 8 MB
    return rows.join(twice, "doc_id", "left").withColumn("copy", F.when(F.col("twice"), F.xxhash64("text")).otherwise(0)).drop("twice"), True


def _repeats(keyed: DataFrame, repeated: bool, plan: Plan) -> DataFrame:
    """Spans of (doc_id, copy, text) rows."""
    src = keyed.where("doc_id is not null").select("doc_id", "copy", "text")
    if repeated:  # equal rows are one document
        src = saved(src.dropDuplicates(["doc_id", "copy"]), "documents")
    packed = not repeated and _fits(src)
    skips, begun = None, mark(src.sparkSession)
    if plan.paragraphs:
        first = saved(_spans(_gone(src, plan, True, packed), plan.min_words), "lines", since=begun)
        skips = saved(first.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("begin", "stop")).alias("skip")), "skips")
        begun = mark(src.sparkSession)
        gone = _gone(src, plan, False, packed, skips).unionByName(first)
    else:
        gone = _gone(src, plan, False, packed)
    if plan.extend:
        gone = _extended(src, gone, plan, skips, begun)
    return _spans(gone, plan.min_words)


def repeats(docs: DataFrame, plan: Plan = WHOLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans to remove: doc_id, start, end (code points, end exclusive), n_words, keep_doc_id (where the first unit of the span stays) and component_id (a number of what stays: the same in every run)."""
    rows, (i, t) = plain(docs, id_col, text_col)
    return _repeats(*_keyed(rows.select(i, t), i, t), plan).select("doc_id", "start", "end", (F.col("stop") - F.col("begin")).cast("long").alias("n_words"), F.col("keep.doc_id").alias("keep_doc_id"), F.col("component").alias("component_id"))


@K.tidied
def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in K.slices(batches):
        out = []
        for text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text is not None and spans:
                parts, at = [], 0
                for s in sorted(spans, key=lambda x: x["start"]):
                    parts.append(text[at : s["start"]])
                    at = max(at, s["end"])
                text = "".join([*parts, text[at:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *b.columns[2:]], names=["text", *b.schema.names[2:]])


def cut(docs: DataFrame, plan: Plan = WHOLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns, with repeated passages cut out of the texts (and n_chars, where there is one, made to fit)."""
    rows, (i, t) = plain(docs, id_col, text_col)
    keyed, repeated = _keyed(rows, i, t)
    spans = _repeats(keyed, repeated, plan)
    spans = spans.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = keyed.join(spans, ["doc_id", "copy"], "left").select("text", "spans", *rows.columns)
    return with_text(joined.mapInArrow(_cutter, fields(rows, StructField("text", StringType()))), docs, text_col)
