"""select, fetch, add, sub, aggregates and join over symbolic handles."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import StatementError
from ..functions import int32
from ..plans.frame import Frame, NumVal, PosVec, Source, ValVec, dense, renamed

_numbers = itertools.count()

#: Join algorithms and the hints that ask Spark for theirs.
ALGORITHMS = {"nested-loop": "shuffle_replicate_nl", "naive-hash": "broadcast", "grace-hash": "shuffle_hash", "hash": None}


def select(vector: ValVec, low: int | None, high: int | None, within: PosVec | None = None) -> PosVec:
    """Positions whose value v has low <= v < high; with `within`, of those positions."""
    condition = int32.in_range(vector.column, low, high)
    if within is None:
        frame = vector.frame.filter(condition, vector.uses)
        if vector.origin is not None:
            return PosVec(frame, vector.frame.sources[0])
        return PosVec(frame, None, vector.frame)
    if vector.frame is not within.frame:
        vector = align(within.frame, vector)
        condition = int32.in_range(vector.column, low, high)
    return PosVec(within.frame.filter(condition, vector.uses), within.source, within.within)


def align(frame: Frame, vector: ValVec) -> ValVec:
    """A vector of another frame, zipped to this one by place; lengths must agree. It is over `frame.own()`."""
    mine, n = dense(frame)
    theirs, m = dense(vector.frame)
    if n != m:
        raise StatementError("Vectors must have the same length.")
    name = f"z{next(_numbers)}"
    other = theirs.select(F.col("__n"), vector.column.alias(name))
    frame = frame.own()
    frame.extend(name, mine.join(other, "__n").drop("__n"))
    return ValVec(frame, F.col(name), frozenset([name]))


def positions(p: PosVec) -> str:
    """Name of a column with the positions of p."""
    if p.source is not None:
        return p.source.pos
    numbers, _ = dense(p.within)
    name = f"n{next(_numbers)}__pos"
    keys = p.within.order
    p.frame.extend(name, p.frame.df.join(numbers.select(*keys, F.col("__n").alias(name)), keys))
    return name


def gather(p: PosVec, values: Frame, column: Column, key: str) -> ValVec:
    """values[p] by a join on position; a position out of range is an error when rows are read."""
    at = positions(p)
    name, there = f"g{next(_numbers)}", f"k{next(_numbers)}"
    found = values.df.select(F.col(key).alias(there), column.alias(name))
    joined = p.frame.df.join(found, F.col(at) == F.col(there), "left")
    checked = F.when(F.col(there).isNull(), F.raise_error(F.lit("Position out of range.")).cast("int")).otherwise(F.col(name))
    p.frame.extend(name, joined.withColumn(name, checked).drop(there))
    return ValVec(p.frame, F.col(name), frozenset([name]))


def fetch(vector: ValVec, p: PosVec) -> ValVec:
    """vector[p], in p's order, duplicates kept."""
    if vector.origin is not None:
        source = vector.frame.sources[0]
        if p.source is not None and (p.source.table, p.source.version) == (source.table, source.version):
            name = p.source.column(vector.origin[1])
            return ValVec(p.frame, F.col(name), frozenset([name]))
        values, _ = renamed(vector.frame)
        return gather(p, values, F.col(values.sources[0].column(vector.origin[1])), values.sources[0].pos)
    if p.source is None and p.within is vector.frame:
        if vector.uses <= set(p.frame.df.columns):
            return ValVec(p.frame, vector.column, vector.uses)
    numbers, _ = dense(vector.frame)
    values = Frame(numbers.select("__n", vector.column.alias("__v")), [], ["__n"])
    return gather(p, values, F.col("__v"), "__n")


def arithmetic(kind: str, a: ValVec, b: ValVec) -> ValVec:
    """Element-wise a + b or a - b in 32 bits."""
    if a.frame is not b.frame:
        b = align(a.frame, b)
        a = ValVec(b.frame, a.column, a.uses)
    make = int32.add if kind == "add" else int32.sub
    return ValVec(a.frame, make(a.column, b.column), a.uses | b.uses)


def aggregate(kind: str, v: ValVec) -> NumVal:
    return NumVal(v.frame, kind, v.column, v.uses)


def join(v1: ValVec, p1: PosVec, v2: ValVec, p2: PosVec, algorithm: str) -> tuple[PosVec, PosVec]:
    """Pairs of equal values, as two aligned position vectors over one joint frame."""
    if algorithm not in ALGORITHMS:
        raise StatementError(f"Unknown join algorithm: {algorithm}.")
    if v1.frame is not p1.frame:
        v1 = align(p1.frame, v1)
    if v2.frame is not p2.frame:
        v2 = align(p2.frame, v2)
    at1, at2 = positions(p1), positions(p2)
    left = p1.frame.df.withColumn("__k1", v1.column)
    right, names = renamed(Frame(p2.frame.df.withColumn("__k2", v2.column), p2.frame.sources, p2.frame.order))
    hint = ALGORITHMS[algorithm]
    other = right.df
    if hint == "broadcast":
        # the smaller side builds the table; sides beyond what may be broadcast are left to Spark
        n1, n2 = p1.frame.df.count(), p2.frame.df.count()
        if min(n1, n2) <= BROADCAST_ROWS:
            if n2 <= n1:
                other = other.hint(hint)
            else:
                left = left.hint(hint)
    elif hint == "shuffle_replicate_nl":
        if p1.frame.df.count() * p2.frame.df.count() <= NESTED_PAIRS:
            other = other.hint(hint)
    elif hint:
        other = other.hint(hint)
    both = left.join(other, F.col("__k1") == F.col(names["__k2"])).drop("__k1", names["__k2"])
    frame = Frame(both, [*p1.frame.sources, *right.sources], [*p1.frame.order, *right.order])

    def side(p: PosVec, at: str, names: dict[str, str] | None) -> PosVec:
        if p.source is not None:
            s = p.source
            if names is not None:
                s = Source(s.table, s.version, names[s.pos][: -len("__pos")])
            return PosVec(frame, s)
        return PosVec(frame, Source("", -1, (names[at] if names else at)[: -len("__pos")]))

    return side(p1, at1, None), side(p2, at2, names)


#: Most rows of a side that is broadcast, and most pairs that a nested loop may look at.
BROADCAST_ROWS = 2_000_000
NESTED_PAIRS = 10**10
