"""Batched queries that share one scan.

Selects of a batch become one pass: the rows are joined with the broadcast table
of bounds (one row per query, a checked number of them) and kept with the number
of each query they satisfy. Aggregates over the results of one batch are one
grouped aggregate.
"""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..errors import StatementError
from ..plans.frame import Frame, NumVal, PosVec, ValVec
from . import vectors

#: Beyond so many selects a batch is run in parts, each with its own bounds.
MOST_BOUNDS = 1024

_numbers = itertools.count()


class Batch:
    """Selects over one value vector (and one position vector), and aggregates over it."""

    def __init__(self) -> None:
        self.vector: ValVec | None = None
        self.within: PosVec | None = None
        self.selects: list[tuple[str | None, int | None, int | None]] = []
        self.aggregates: list[tuple[str | None, str]] = []

    def _same(self, v: ValVec) -> None:
        if self.vector is None:
            self.vector = v
        elif self.vector.frame is not v.frame or self.vector.uses != v.uses or self.vector.column._jc.toString() != v.column._jc.toString():
            raise StatementError("Incompatible batch query.")

    def add_select(self, handle: str | None, v: ValVec, low: int | None, high: int | None, within: PosVec | None) -> None:
        if self.selects and (self.within is None) != (within is None) or self.within is not None and within is not None and self.within.frame is not within.frame:
            raise StatementError("Incompatible batch query.")
        self._same(v)
        self.within = within
        self.selects.append((handle, low, high))

    def add_aggregate(self, handle: str | None, kind: str, v: ValVec) -> None:
        self._same(v)
        self.aggregates.append((handle, kind))

    def run(self) -> tuple[dict[str, PosVec], dict[str, NumVal]]:
        found: dict[str, PosVec] = {}
        numbers = {h: vectors.aggregate(kind, self.vector) for h, kind in self.aggregates if h}
        named = [s for s in self.selects if s[0]]
        for i in range(0, len(named), MOST_BOUNDS):
            found |= self._select(named[i : i + MOST_BOUNDS])
        return found, numbers

    def _select(self, named: list[tuple[str, int | None, int | None]]) -> dict[str, PosVec]:
        v, within = self.vector, self.within
        if len(named) == 1:
            return {named[0][0]: vectors.select(v, named[0][1], named[0][2], within)}
        if within is not None and v.frame is not within.frame:
            v = vectors.align(within.frame, v)
        frame = within.frame if within is not None else v.frame
        tag = f"q{next(_numbers)}"
        least, most = -(2**63), 2**63 - 1
        rows = [(q, least if low is None else low, most if high is None else high) for q, (_, low, high) in enumerate(named)]
        bounds = frame.df.sparkSession.createDataFrame(rows, f"{tag} int, {tag}_lo long, {tag}_hi long")
        # an upper bound that is open also admits the largest 32-bit value: no value reaches 2**63 - 1
        tagged = frame.df.join(F.broadcast(bounds), (v.column >= F.col(f"{tag}_lo")) & (v.column < F.col(f"{tag}_hi"))).drop(f"{tag}_lo", f"{tag}_hi")
        shared = Frame(tagged, frame.sources, [tag, *frame.order])
        out = {}
        for q, (handle, _, _) in enumerate(named):
            mine = Frame(tagged.filter(F.col(tag) == q), frame.sources, frame.order, tag=(shared, tag, q))
            source = within.source if within is not None else v.frame.sources[0] if v.origin is not None else None
            out[handle] = PosVec(mine, source, None if source is not None else (within.within if within is not None else v.frame))
        return out
