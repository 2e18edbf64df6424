"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths, in numpy over the bytes of many texts,
find the words that lie inside n-grams occurring twice or more in their text,
and the lines equal to an earlier line. Shares of characters inside them decide.

Everything is computed on one text alone, so the operator is one narrow pass
without a shuffle, and a lost executor's part is simply computed again.

Defined results: a null text has no words and fails the base rule; an empty
table gives an empty result; repeated rows each get their own row; extra columns
are not read (`assess`) or kept as they are (`keep_good`), whatever their names.
Every row of the input, also one with a null id, has one row in the output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Rules:
    """Thresholds, in percent. Shares are of the characters inside words.

    `gram_share` holds (n, most share inside duplicated n-grams); each length must
    be larger than the one before, which lets longer n-grams be looked for only
    where shorter ones repeat (exactly the same result, less sorting).
    """

    min_words: int = 50
    max_repeat_words: int = 50
    gram_share: tuple[tuple[int, int], ...] = ((5, 30), (7, 28), (10, 26))
    line_share: int = 20
    dup_line_share: int = 50
    symbols_per_word: int = 10


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_gram_chars array<long>, base_failed boolean, kept boolean"
ARROW = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("dup_line_chars", pa.int64()), ("dup_gram_chars", pa.list_(pa.int64())), ("base_failed", pa.bool_()), ("kept", pa.bool_())])


def measure(buf: np.ndarray, off: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """All figures of the texts of one chunk."""
    docs = len(off) - 1
    w = K.Words(buf, off)
    points = (buf & 0xC0) != 0x80
    solid_points = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(points & w.solid, out=solid_points[1:])
    doc = w.doc()
    total = len(w.start)
    length = solid_points[w.end] - solid_points[w.start]
    out = {"n_words": w.count.astype(np.int64), "word_chars": solid_points[off[1:]] - solid_points[off[:-1]], "n_symbols": K.per_doc(_SYMBOL[buf], off)}

    # lines: [start, end) between line feeds and text ends, with a word in them
    feed = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], feed + 1]))
    start = start[start < len(buf)]
    start = start[buf[start] != 10]
    stop = np.full(len(buf) + 1, False)
    stop[feed] = True
    stop[off[1:]] = True
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, start, "right")] if len(start) else start
    chars = solid_points[end] - solid_points[start]
    start, end, chars = start[chars > 0], end[chars > 0], chars[chars > 0]
    line_doc = np.searchsorted(off, start, "right") - 1
    key = K.span_hash(w.total, start, end) ^ K.mix(line_doc.astype(np.uint64) + np.uint64(1))
    _, later = K.repeated(key)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=docs).astype(np.int64)
    out["dup_line_chars"] = np.bincount(line_doc[later], weights=chars[later], minlength=docs).astype(np.int64)
    n_lines = np.bincount(line_doc, minlength=docs)

    left = w.left()
    salt = K.mix(doc.astype(np.uint64) + np.uint64(1))

    def twice(at: np.ndarray, n: int) -> np.ndarray:
        at = at[left[at] >= n]
        if not len(at):
            return at
        g = K.grams(w.hash, n)[at] ^ salt[at]
        return at[K.repeated(g)[0]]

    at = twice(np.arange(total), 3)
    inside = K.cover(at, 3, total)
    out["n_repeat_words"] = np.bincount(doc[inside], minlength=docs).astype(np.int64)
    shares = []
    for n, _ in rules.gram_share:
        at = twice(at, n)  # an n-gram can repeat only where its first words do
        inside = K.cover(at, n, total)
        shares.append(np.bincount(doc[inside], weights=length[inside], minlength=docs).astype(np.int64))
    out["dup_gram_chars"] = shares

    words, letters = out["n_words"], np.maximum(out["word_chars"], 1)
    out["base_failed"] = (words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_words * words)
    bad = out["base_failed"] | (100 * out["dup_line_chars"] > rules.line_share * letters) | (100 * out["n_dup_lines"] > rules.dup_line_share * np.maximum(n_lines, 1)) | (100 * out["n_symbols"] > rules.symbols_per_word * words)
    for (_, most), got in zip(rules.gram_share, shares, strict=True):
        bad |= 100 * got > most * letters
    out["kept"] = ~bad
    return out


def measured(texts: pa.Array, rules: Rules) -> dict[str, np.ndarray | list[np.ndarray]]:
    """The same for a whole Arrow array."""
    parts = [measure(buf, off, rules) for _, _, buf, off in K.chunks(texts)]
    if not parts:
        parts = [measure(np.zeros(0, np.uint8), np.zeros(1, np.int64), rules)]
    join = lambda k: [np.concatenate([p[k][i] for p in parts]) for i in range(len(rules.gram_share))] if k == "dup_gram_chars" else np.concatenate([p[k] for p in parts])
    return {k: join(k) for k in parts[0]}


def assess(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, the figures and `kept`."""

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measured(b.column(1), rules)
            grams = np.stack(m["dup_gram_chars"], axis=1).ravel() if rules.gram_share else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(rules.gram_share)), pa.array(grams))
            yield pa.RecordBatch.from_arrays([b.column(0), *(lists if f.name == "dup_gram_chars" else pa.array(m[f.name]) for f in ARROW)], names=["doc_id", *ARROW.names])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id long, {RESULT}")


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The rows that pass, all columns unchanged."""
    where = docs.columns.index(text_col)

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(measured(b.column(where), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
