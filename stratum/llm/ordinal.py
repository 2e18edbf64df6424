"""A quality classifier: ordinal cumulative-link regression on graded ratings.

With hashed text features x, weights w shared by all grades and ordered
thresholds t_1 < t_2 < ...,

    P(grade >= k) = 1 / (1 + exp(t_k - w.x)).

Features are the words of the whole text and their beginnings (hashed, by the
logarithm of their counts, scaled by the root of their number) and a few figures of its shape in steps. The model is fitted on the
driver by gradient descent on a bounded sample of rated texts (`sample` rows, those
of the least hashes of their ids, 4,000 by default); scoring is one narrow pass
over all texts.

Defined results: a null text is empty and is scored by its shape alone; very long
texts are read whole; ratings that are null, or of no text, are left out; rows that
repeat, or have a null id, are each scored, and where ids repeat among rated texts
those of the least hashes make the sample; a chance equal to the threshold keeps; an
empty table gives an empty result; without any ratings the model gives every grade
the same chance; a grade beyond those seen in training has no chance; extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .pii import terms
from .quality_rules import _SYMBOL

STEPS = 12
SHAPES = 8
PREFIXES = (4, 6, 7)  # bytes


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    sample: int = 4_000
    least_texts: int = 3  # a word counts if so many texts of the sample have it
    penalty: float = 2e-5
    rounds: int = 500
    rate: float = 0.05


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    thresholds: np.ndarray
    bits: int

    def chances(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one row per text."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -50, 50)))


def features(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) triples of one chunk, sorted by text."""
    docs = len(off) - 1
    w, s, e, h = terms(buf, off)
    doc = w.doc().astype(np.int64)
    total = K.prefix(buf, K.BYTE_VALUE_LOWER)
    triples = []
    for n in (0, *PREFIXES):  # whole words, then their beginnings (stems, whatever the language)
        own = h if not n else K.span_hash(total, s, np.minimum(e, s + n)).view(np.int64) ^ n
        key, count = np.unique(doc << bits | (own & ((1 << bits) - 1)), return_counts=True)
        text = key >> bits
        several = np.bincount(text, minlength=docs)
        if not n:
            distinct = several
        triples.append((text, key & ((1 << bits) - 1), np.log1p(np.minimum(count, 4)) / np.sqrt(np.maximum(several, 1))[text]))
    words = np.maximum(w.count, 1)
    length = np.bincount(doc, weights=e - s, minlength=docs)
    shape = np.stack([
        K.per_doc(_SYMBOL[buf], off) / words * 12,
        distinct / words * STEPS,
        length / words,
        np.log2(words),
        K.per_doc(buf == 10, off) / words * 30,
        np.bincount(doc, weights=e - s < 2, minlength=docs) / words * 12,
        K.per_doc((buf >= 65) & (buf <= 90), off) / words * 4,
        K.per_doc(buf == 33, off) / words * 8,
    ], axis=1)
    step = np.clip(shape, 0, STEPS - 1).astype(np.int64) + (1 << bits) + np.arange(SHAPES) * STEPS
    triples.append((np.repeat(np.arange(docs), SHAPES), step.ravel(), np.full(docs * SHAPES, 1.0)))
    text, feature, value = (np.concatenate(x) for x in zip(*triples, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], feature[order], value[order]


def train(grade: np.ndarray, text: np.ndarray, feature: np.ndarray, value: np.ndarray, settings: Settings) -> Model:
    """Least penalised negative log likelihood, by Adam on the whole sample."""
    size = (1 << settings.bits) + SHAPES * STEPS
    n, grades = len(grade), int(grade.max()) + 1 if len(grade) else 1
    if not n or grades < 2:
        return Model(np.zeros(size, np.float32), np.zeros(max(grades - 1, 1)), settings.bits)
    df = np.bincount(feature, minlength=size)
    use = df[feature] >= settings.least_texts
    known = np.flatnonzero(df >= settings.least_texts)
    number = np.zeros(size, np.int32)
    number[known] = np.arange(len(known))
    text, code, value = text[use], number[feature[use]], value[use]
    del feature, use
    share = np.array([np.mean(grade >= k) for k in range(1, grades)]).clip(1e-3, 1 - 1e-3)
    first = np.minimum.accumulate(share)
    base = -np.log(first / (1 - first))
    # free parameters: weights, first threshold, logs of the gaps
    gaps = np.log(np.maximum(np.diff(base), 0.1))
    p = np.concatenate([np.zeros(len(known)), base[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for it in range(1, settings.rounds + 1):
        w, t = p[: len(known)], np.cumsum(np.r_[p[len(known)], np.exp(p[len(known) + 1 :])])
        z = np.bincount(text, weights=w[code] * value, minlength=n)
        tail = np.ones((n, grades + 1))
        tail[:, 1:grades] = 1 / (1 + np.exp(np.clip(t[None, :] - z[:, None], -50, 50)))
        tail[:, grades] = 0
        slope = tail * (1 - tail)
        chance = np.maximum(tail[rows, grade] - tail[rows, grade + 1], 1e-12)
        up, down = slope[rows, grade] / chance, slope[rows, grade + 1] / chance
        dz = -(up - down) / n
        gw = np.bincount(code, weights=dz[text] * value, minlength=len(known)) + settings.penalty * w
        dt = np.array([(up[grade == k].sum() if (grade == k).any() else 0.0) - (down[grade == k - 1].sum() if (grade == k - 1).any() else 0.0) for k in range(1, grades)]) / n
        after = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([gw, after[:1], after[1:] * np.exp(p[len(known) + 1 :])])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p -= settings.rate * (20 if it < settings.rounds // 2 else 5) * 0.2 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.999**it)) + 1e-8)
    full = np.zeros(size, np.float32)
    full[known] = p[: len(known)]
    return Model(full, np.cumsum(np.r_[p[len(known)], np.exp(p[len(known) + 1 :])]), settings.bits)


def fit(docs: DataFrame, ratings: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """Fit on at most `settings.sample` rated texts. `ratings` has the id and a grade from 0."""

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in K.chunks(b.column(1)):
                text, feature, value = features(buf, off, settings.bits)
                at = np.searchsorted(text, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([feature[s:e].astype("<i4").tobytes() for s, e in zip(at, at[1:], strict=False)], pa.binary()), pa.array([value[s:e].astype("<f4").tobytes() for s, e in zip(at, at[1:], strict=False)], pa.binary())], names=["grade", "feature", "value"])

    rated = ratings.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("long").alias("grade")).where("id is not null and grade >= 0")
    rated = rated.orderBy(F.xxhash64("id"), "id", "grade").limit(settings.sample)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = src.join(F.broadcast(rated), "id").where("text is not null")  # at most `sample` rows of two numbers
    # ids may repeat: of more rows than the sample those of the least hashes count, whatever the partitioning
    rows = rows.orderBy(F.xxhash64("id"), "id", "grade", F.xxhash64("text")).limit(settings.sample).select("grade", "text")
    got = rows.mapInArrow(run, "grade long, feature binary, value binary").toArrow()  # some 10 KB a text
    grade = got.column("grade").to_numpy().astype(np.int64)
    size = np.array([len(x) // 4 for x in got.column("feature").to_pylist()], np.int64)
    text = np.repeat(np.arange(len(grade), dtype=np.int32), size)
    feature = np.frombuffer(b"".join(got.column("feature").to_pylist()), "<i4")
    value = np.frombuffer(b"".join(got.column("value").to_pylist()), "<f4")
    del got
    return train(grade, text, feature, value, settings)


def score(docs: DataFrame, model: Model, tail: int = 2, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, expected_grade, tail_probability (of grade `tail` or better) and kept (at least `least`)."""

    @K.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in K.chunks(b.column(1)):
                text, feature, value = features(buf, off, model.bits)
                z = np.bincount(text, weights=model.weight[feature] * value, minlength=j - i)
                p = model.chances(z)
                good = p[:, tail - 1] if tail <= p.shape[1] else np.zeros(len(p))  # no such grade was seen
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.round(p.sum(axis=1), 6)), pa.array(np.round(good, 6)), pa.array(good >= least)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double, kept boolean")
