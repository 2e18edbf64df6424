"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse integer rows over terms (here: dimensions). Candidates are
grouped into blocks of postings (term -> rows and weights), queries into blocks of
term rows; each pair of blocks scatters weighted postings, one term at a time,
into a dense array of scores, and partition selection takes the k highest of it.
The lists of all candidate blocks are merged by rank.

Queries are a stated set against all rows, in blocks: a query block goes to a
number of lanes, over which the candidate blocks are spread, so that the pairs of
blocks are even work for all tasks. No pair of rows is ever a row of a table.

Defined results: vectors that are null or hold null or non-finite components,
and rows without an id, take no part; vectors may differ in length (what is
missing counts as nothing); rows that repeat an id are candidates each, and one
query; ties go to the smaller id; an empty table gives an empty result; extra
columns are not read. Scores are 64-bit integers (components beyond 2**28 after
scaling may wrap).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K

CANDIDATES = 1024
QUERIES = 2048
LEAST_LANES = 16


def usable(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the vectors that take part, their offsets and their flat components."""
    n = len(vectors)
    off = np.asarray(vectors.offsets, np.int64) if n else np.zeros(1, np.int64)
    values = vectors.values
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(flat)
    if values.null_count:
        bad |= np.asarray(values.is_null())
    total = np.r_[0, np.cumsum(bad)]
    rows = np.flatnonzero(np.asarray(vectors.is_valid()) & (total[off[1:]] == total[off[:-1]])) if n else np.zeros(0, np.int64)
    size = off[rows + 1] - off[rows]
    at = np.r_[0, np.cumsum(size)]
    return rows, at, flat[np.arange(at[-1]) + np.repeat(off[rows] - at[:-1], size)]


def pack_rows(ids: np.ndarray, at: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict[str, bytes]:
    """A block as bytes, its entries sorted by term (zero weights left out)."""
    row = np.repeat(np.arange(len(ids)), np.diff(at))
    order = np.lexsort((row, term))
    order = order[weight[order] != 0]
    return {"ids": ids.astype(np.int64).tobytes(), "term": term[order].astype(np.int32).tobytes(), "row": row[order].astype(np.int32).tobytes(), "weight": weight[order].astype(np.int64).tobytes()}


def postings(block: dict) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    term, row, weight = (np.frombuffer(block[k], t) for k, t in (("term", np.int32), ("row", np.int32), ("weight", np.int64)))
    at = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    end = np.r_[at[1:], len(term)]
    return np.frombuffer(block["ids"], np.int64), {int(term[s]): (row[s:e], weight[s:e]) for s, e in zip(at, end, strict=True)}


def accumulate(queries: dict, candidates: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores) of a pair of blocks."""
    q_ids, q_terms = postings(queries)
    c_ids, c_terms = postings(candidates)
    scores = np.zeros((len(q_ids), len(c_ids)), np.int64)
    for t, (q_row, q_weight) in q_terms.items():
        if t not in c_terms:
            continue
        c_row, c_weight = c_terms[t]
        part = q_weight[:, None] * c_weight[None, :]
        if len(q_row) == len(q_ids) and len(c_row) == len(c_ids):
            scores += part
        else:
            scores[np.ix_(q_row, c_row)] += part
    return q_ids, c_ids, scores


def select(q_ids: np.ndarray, c_ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest candidates of each query (ties to the smaller id), its own id left out."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, scores = c_ids[order], scores[:, order]
    own_lo, own_hi = np.searchsorted(c_ids, q_ids), np.searchsorted(c_ids, q_ids, "right")
    out = []
    for i in range(len(q_ids)):
        s, ids = scores[i], c_ids
        if own_lo[i] < own_hi[i]:
            s = np.delete(s, np.s_[own_lo[i] : own_hi[i]])
            ids = np.delete(ids, np.s_[own_lo[i] : own_hi[i]])
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > least)
            at = np.r_[above, np.flatnonzero(s == least)[: k - len(above)]]
        else:
            at = np.arange(len(s))
        out.append((ids[at], s[at]))
    return np.repeat(q_ids, [len(x) for x, _ in out]), np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


_BLOCK = "ids binary, term binary, row binary, weight binary"
_NAMES = ["ids", "term", "row", "weight"]


def _blocks(scale: float, most: int):
    """(id, vector) rows to blocks of up to `most` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def emit() -> pa.RecordBatch:
            ids = np.concatenate([x for x, *_ in held])
            size = np.concatenate([np.diff(a) for _, a, _ in held])
            flat = np.concatenate([x for *_, x in held])
            at = np.r_[0, np.cumsum(size)]
            term = np.arange(at[-1]) - np.repeat(at[:-1], size)
            weight = np.floor(flat * scale)
            weight = np.clip(weight, -(2.0**62), 2.0**62).astype(np.int64)
            b = pack_rows(ids, at, term, weight)
            return pa.RecordBatch.from_arrays([pa.array([b[k]], pa.binary()) for k in _NAMES], names=_NAMES)

        for b in batches:
            for i in range(0, b.num_rows, most):
                part = b.slice(i, most)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                rows, at, flat = usable(pa.concat_arrays([part.column(1)]))
                if not len(rows):
                    continue
                if count and count + len(rows) > most:
                    yield emit()
                    held, count = [], 0
                held.append((ids[rows], at, flat))
                count += len(rows)
        if held:
            yield emit()

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(b.num_rows):
                q = {n: K.column(b, f"q_{n}")[x].as_py() for n in _NAMES}
                c = {n: K.column(b, n)[x].as_py() for n in _NAMES}
                a, i, s = select(*accumulate(q, c), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", lanes: int | None = None, block: int = CANDIDATES, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest inner products among all other rows.

    Components x count as floor(scale * x). `lanes`: tasks that share the pairs of
    blocks (as many as the session's shuffle partitions, 16 at least).
    """
    lanes = lanes or max(LEAST_LANES, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and vector is not null")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))  # of rows that repeat an id, an unusable one is no query
    asked = pick(queries).where(sound).groupBy("id").agg(F.min("vector").alias("vector"))
    many = max(1, -(-asked.count() // query_block))
    asked = asked.repartition(many, F.xxhash64("id")).select("id", "vector").mapInArrow(_blocks(scale, query_block), _BLOCK)
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), *(F.col(n).alias(f"q_{n}") for n in _NAMES))
    given = pick(vectors).mapInArrow(_blocks(scale, block), _BLOCK).select(F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int").alias("lane"), *_NAMES)
    # dealt by number: the work is in the pairs, not in the bytes by which Spark would merge partitions
    pairs = given.repartition(lanes, "lane").join(asked.repartition(lanes, "lane").hint("merge"), "lane")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
