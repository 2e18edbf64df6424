"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The pieces and log scores of a SentencePiece model file become a double-array
trie over UTF-8 bytes, built once on the driver (its size is that of the
vocabulary) and sent to the tasks. Encoding finds the segmentation of the highest
total score; a character that no piece covers costs the least piece score less 10
and becomes byte pieces. Ties go to the segmentation whose last piece begins
first, as they do in the public library.

No piece of the supported models crosses from other characters into a white-space
marker, and none holds a line feed or tab, so the best segmentation of a text is
that of its words one by one; this is checked when a model is read, and texts of
other models are searched whole. Words are searched many at a time in numpy, and
a bounded cache keeps their ids.

Defined results: a null or empty text has no ids; rows that repeat, or have a
null id, each get their own row; an empty table gives an empty result; extra
columns are not read. The marker U+2581 in a text counts as a space, so it is the
only character that decoding does not give back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .packing import WordCache

MARKER = "▁".encode()
UNKNOWN_PENALTY = 10.0
NORMAL, USER_DEFINED, BYTE = 1, 4, 6  # piece types of the model format


class DoubleArray:
    """base and check arrays of a trie over bytes; value is the piece at a node, or -1."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for word, number in words.items():
            node = 0
            for c in word:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = number
        size = 4 * len(children) + 1024
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        place = {0: 0}
        self.value[0] = ends[0]
        first = 1  # no free place before it
        # wide nodes first, single children then fill the gaps
        for node in sorted((n for n in range(len(children)) if children[n]), key=lambda n: -len(children[n])):
            codes = sorted(children[node])
            while used[first]:
                first += 1
            b = max(first - codes[0], 1 - codes[0])
            while any(used[b + c] for c in codes):
                b += 1
                while used[b + codes[0]]:
                    b += 1
            for c in codes:
                used[b + c] = 1
                place[children[node][c]] = b + c
            place[~node] = b
        for node, kids in enumerate(children):
            at = place[node]
            self.value[at] = ends[node]
            if kids:
                self.base[at] = place[~node]
                for c in kids:
                    self.check[place[~node] + c] = at
            else:
                self.base[at] = size - 256  # an area without nodes
        top = max(place[n] for n in range(len(children))) + 1
        blank = top
        self.base = np.where(self.base[:top] == size - 256, blank, self.base[:top]).astype(np.int32)
        grow = np.full(512, -1, np.int32)
        self.check = np.r_[self.check[:top], grow]
        self.value = np.r_[self.value[:top], grow]
        self.base = np.r_[self.base, np.full(512, blank, np.int32)]


@dataclass
class Model:
    trie: DoubleArray
    score: np.ndarray
    unknown: float
    byte_ids: np.ndarray
    dummy_prefix: bool
    by_word: bool
    text: np.ndarray  # bytes of all pieces, markers as spaces
    text_at: np.ndarray
    is_byte: np.ndarray


@lru_cache(maxsize=4)
def read_model(path: str) -> Model:
    """A SentencePiece model file (identity normalisation) as arrays."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with identity normalisation are supported")
    words, byte_ids, texts = {}, np.full(256, -1, np.int64), []
    score = np.array([p.score for p in m.pieces], np.float64)
    is_byte = np.zeros(len(m.pieces), bool)
    for i, p in enumerate(m.pieces):
        raw = p.piece.encode()
        if p.type in (NORMAL, USER_DEFINED):
            words[raw.replace(MARKER, b" ")] = i
            texts.append(raw.replace(MARKER, b" "))
        elif p.type == BYTE:
            byte_ids[int(p.piece[3:5], 16)] = i
            is_byte[i] = True
            texts.append(bytes([int(p.piece[3:5], 16)]))
        else:
            texts.append(b"")
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte fallback")
    by_word = all(b" " not in w.lstrip(b" ") and b"\n" not in w and b"\t" not in w for w in words)
    least = min(score[i] for i in words.values())
    at = np.r_[0, np.cumsum([len(t) for t in texts])]
    return Model(DoubleArray(words), score, least - UNKNOWN_PENALTY, byte_ids, m.normalizer_spec.add_dummy_prefix, by_word, np.frombuffer(b"".join(texts), np.uint8), at, is_byte)


def _char_size(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def viterbi(m: Model, words: list[bytes]) -> list[np.ndarray]:
    """Ids of each word, one array each."""
    out: list[np.ndarray | None] = [None] * len(words)
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    i = 0
    while i < len(order):
        n = len(words[order[i]])
        j = i
        while j < len(order) and len(words[order[j]]) <= n + n // 4 and j - i < 8192:
            j += 1
        part = order[i:j]
        found = _many(m, [words[k] for k in part]) if j - i >= 16 and n else [_one(m, words[k]) for k in part]
        for k, ids in zip(part, found, strict=True):
            out[k] = ids
        i = j
    return out


def _one(m: Model, word: bytes) -> np.ndarray:
    base, check, value = m.trie.base, m.trie.check, m.trie.value
    n = len(word)
    best = [-np.inf] * (n + 1)
    back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
    best[0] = 0.0
    s = 0
    while s < n:
        step = 1 if word[s] < 0x80 else 2 if word[s] < 0xE0 else 3 if word[s] < 0xF0 else 4
        node, single, here = 0, False, best[s]
        for e in range(s, n):
            go = int(base[node]) + word[e]
            if check[go] != node:
                break
            node = go
            v = int(value[node])
            if v >= 0:
                single |= e + 1 - s == step
                got = here + float(m.score[v])
                if got > best[e + 1]:
                    best[e + 1], back[e + 1] = got, (s, v)
        e = min(s + step, n)
        if not single and here + m.unknown > best[e]:
            best[e], back[e] = here + m.unknown, (s, -1)
        s += step
    ids: list[int] = []
    while n:
        s, v = back[n]
        ids += [v] if v >= 0 else [int(m.byte_ids[c]) for c in reversed(word[s:n])]
        n = s
    return np.array(ids[::-1], np.uint32)


def _many(m: Model, words: list[bytes]) -> list[np.ndarray]:
    base, check, value = m.trie.base, m.trie.check, m.trie.value
    n = len(words)
    size = np.array([len(w) for w in words])
    longest = int(size.max())
    text = np.zeros((longest + 4, n), np.uint8)
    text[:longest] = np.frombuffer(b"".join(w.ljust(longest, b"\0") for w in words), np.uint8).reshape(n, longest).T
    best = np.full((longest + 5, n), -np.inf)
    best[0] = 0.0
    back = np.zeros((longest + 5, n), np.int32)
    piece = np.full((longest + 5, n), -1, np.int32)
    for s in range(longest):
        rows = np.flatnonzero((best[s] > -np.inf) & (size > s))
        if not len(rows):
            continue
        here = best[s, rows]
        step = _char_size(text[s, rows])
        single = np.zeros(len(rows), bool)
        live, node, e = np.arange(len(rows)), np.zeros(len(rows), np.int32), s
        while len(live):
            go = base[node] + text[e, rows[live]]
            ok = (check[go] == node) & (size[rows[live]] > e)
            live, node = live[ok], go[ok]
            e += 1
            v = value[node]
            hit = v >= 0
            if hit.any():
                x = live[hit]
                r, v = rows[x], v[hit]
                single[x] |= step[x] == e - s
                got = here[x] + m.score[v]
                better = got > best[e, r]
                r = r[better]
                best[e, r], back[e, r], piece[e, r] = got[better], s, v[better]
        lone = np.flatnonzero(~single)
        if len(lone):
            r = rows[lone]
            to = np.minimum(s + step[lone], size[r])
            got = here[lone] + m.unknown
            better = got > best[to, r]
            r, to = r[better], to[better]
            best[to, r], back[to, r], piece[to, r] = got[better], s, -1
    # walk back, all words at once; unknown characters become their bytes
    at = size.copy()
    rows = np.flatnonzero(at > 0)
    who, where, ids = [], [], []
    while len(rows):
        e = at[rows]
        s, v = back[e, rows], piece[e, rows]
        known = v >= 0
        who.append(rows[known])
        where.append(s[known])
        ids.append(v[known].astype(np.int64))
        for x in np.flatnonzero(~known):
            for p in range(s[x], e[x]):
                who.append(rows[x : x + 1])
                where.append(np.array([p]))
                ids.append(m.byte_ids[text[p, rows[x]]].reshape(1))
        at[rows] = s
        rows = rows[s > 0]
    if not who:
        return [np.zeros(0, np.uint32) for _ in words]
    w, p, k = np.concatenate(who), np.concatenate(where), np.concatenate(ids)
    order = np.lexsort((p, w))
    return np.split(k[order].astype(np.uint32), np.searchsorted(w[order], np.arange(1, n)))


class PieceCache(WordCache):
    """Ids of words (with the white space before them) by Viterbi search."""

    def __init__(self, model: Model, most: int = 800_000):
        self.model, self.most = model, most
        self.clear()

    def fresh(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = viterbi(self.model, words)
        return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)

    def encode_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their offsets."""
        lead = b" " if self.model.dummy_prefix else b""
        texts = [lead + t.replace(MARKER, b" ") if t else t for t in texts]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        off = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        begin = np.zeros(n + 1, bool)
        begin[off] = True
        if self.model.by_word:
            space, own = buf == 0x20, (buf == 0x0A) | (buf == 0x09)
            begin[:n] |= own
            begin[1:n] |= (space[1:] & ~space[:-1]) | own[:-1]
        start = np.flatnonzero(begin[:n])
        end = np.r_[start[1:], n]
        total = K.prefix(buf, K.BYTE_VALUE)
        key, first, inverse = np.unique(K.span_hash(total, start, end), return_index=True, return_inverse=True)
        s, e = start[first], end[first]
        check = (e - s).astype(np.uint64)
        for j in range(1, 5):
            check = check << np.uint64(8) | np.where(s + j < e, buf[np.minimum(s + j, n - 1)], 0).astype(np.uint64)
        data = buf.tobytes()
        begins, size = self.places(key, check, lambda k: data[s[k] : e[k]])
        begins, size = begins[inverse], size[inverse]
        at = np.r_[0, np.cumsum(size)]
        flat = self.pool[np.arange(at[-1]) + np.repeat(begins - at[:-1], size)]
        return flat, at[np.searchsorted(start, off)]


def decode(m: Model, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Bytes of each run of ids: pieces joined, markers as spaces, the prefix space taken off."""
    size = m.text_at[ids + 1] - m.text_at[ids] if len(ids) else np.zeros(0, np.int64)
    to = np.r_[0, np.cumsum(size)]
    data = m.text[np.arange(to[-1]) + np.repeat(m.text_at[ids] - to[:-1], size)].tobytes() if len(ids) else b""
    cut = 1 if m.dummy_prefix else 0
    return [data[s + (cut if data[s : s + 1] == b" " else 0) : e] if e > s else b"" for s, e in zip(to[at[:-1]].tolist(), to[at[1:]].tolist(), strict=True)]


def encode(docs: DataFrame, path: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_ids, n_fallback (byte pieces), ids_crc32, decoded_crc32, round_trip (and ids as little-endian uint32)."""
    model = read_model(path)

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = PieceCache(model)
        for b in batches:
            for i, j, buf, off in K.chunks(b.column(1), 2 * K.CHUNK_BYTES):
                data = buf.tobytes()
                texts = [data[s:e] for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                ids, at = cache.encode_texts(texts)
                back = decode(model, ids, at)
                raw = ids.astype("<u4").tobytes()
                runs = [raw[4 * s : 4 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                cols = [b.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(K.per_doc(model.is_byte[ids], at)), pa.array([zlib.crc32(x) for x in runs], pa.int64()), pa.array([zlib.crc32(x) for x in back], pa.int64()), pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())]
                names = ["doc_id", "n_ids", "n_fallback", "ids_crc32", "decoded_crc32", "round_trip"]
                if with_ids:
                    cols.append(pa.array(runs, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_ids long, n_fallback long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + (", ids binary" if with_ids else ""))


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of rows of little-endian uint32 ids; bytes that are not UTF-8 become U+FFFD."""
    model = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [np.frombuffer(x or b"", "<u4") for x in b.column(1).to_pylist()]
            at = np.r_[0, np.cumsum([len(x) for x in runs])].astype(np.int64)
            flat = np.concatenate([np.zeros(0, np.uint32), *runs]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode("utf-8", "replace") for x in decode(model, flat, at)], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
