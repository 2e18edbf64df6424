"""A filter of bounded size for rows whose key a table may hold.

It lets every key of the table through and few others, so that rows which a later
join would drop need not reach it. The join decides: the size of the filter
changes how many rows get there, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

LEAST, MOST, PLACES, BLOCK = 1 << 16, 1 << 27, 3, 1 << 16  # bits at least and at most (16 MB), bits of a key, bytes of a block
_U = np.uint64


def places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = keys.view(np.uint64)
    for j in range(PLACES):
        yield K.mix(h + _U(0x9E3779B97F4A7C15 * (j + 1) % 2**64)) & _U(bits - 1)


def passes(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys the filter lets through."""
    out = np.ones(len(keys), bool)
    for p in places(keys, len(filled) * 8):
        out &= (filled[p >> _U(3)] >> (p & _U(7)).astype(np.uint8)) & 1 != 0
    return out


def _fill(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for p in places(b.column(0).to_numpy(), bits):
                np.bitwise_or.at(filled, p >> _U(3), np.left_shift(np.uint8(1), (p & _U(7)).astype(np.uint8)))
        step = min(BLOCK, len(filled))
        for at in range(0, len(filled), step):
            part = filled[at : at + step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = [np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in xs]).tobytes() for xs in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(parts, pa.binary())], names=["at", "part"])


def sieve(keys: DataFrame):
    """A broadcast filter (an array of bytes, see `passes`) of a saved table's only column of longs."""
    bits = min(MOST, max(LEAST, 1 << (16 * keys.count()).bit_length()))
    some = keys.coalesce(8).mapInArrow(_fill(bits), "at long, part binary")  # so many filters at most are merged
    found = some.groupBy("at").agg(F.collect_list("part")).mapInArrow(_merged, "at long, part binary").collect()
    filled = np.zeros(bits // 8, np.uint8)
    for at, part in found:
        filled[at : at + len(part)] = np.frombuffer(part, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(filled)
