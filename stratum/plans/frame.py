"""Symbolic handles.

A frame is a lazy DataFrame whose rows are the aligned elements of vectors. A
position vector is a frame and one of its sources; a value vector is a column
over a frame. A chain of select, fetch, add and aggregate over one frame is one
Catalyst plan with one scan.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FAILURES, message
from ..functions import int32

_numbers = itertools.count()


@dataclass(frozen=True)
class Source:
    """An occurrence of a table version in a frame; its columns are prefix + name, its positions prefix + __pos."""

    table: str
    version: int
    prefix: str

    @property
    def pos(self) -> str:
        return f"{self.prefix}__pos"

    def column(self, name: str) -> str:
        return f"{self.prefix}{name}"


@dataclass(eq=False)
class Frame:
    df: DataFrame
    sources: list[Source]
    order: list[str]  # columns that identify and order the rows
    predicate: Column | None = None  # set while the frame is a filter over one table
    base: Frame | None = None
    covering: tuple[frozenset[str], DataFrame] | None = None  # an index that has these columns, filtered alike
    tag: tuple[Frame, str, int] | None = None  # (shared frame, column of the query number, number)
    length: int | None = None
    indexes: dict[str, DataFrame] = field(default_factory=dict)  # column -> its sorted projection
    shared: bool = False  # a table's own frame, which all handles over the table start from

    def filter(self, condition: Column | None, uses: frozenset[str] = frozenset()) -> Frame:
        if condition is None:
            condition = F.lit(True)
        predicate = condition if self.base is None else self.predicate & condition if self.predicate is not None else None
        covering = None
        if len(uses) == 1 and (column := next(iter(uses))) in self.indexes:
            covering = uses | {self.sources[0].pos}, self.indexes[column].filter(condition)
        elif self.covering and uses <= self.covering[0]:
            covering = self.covering[0], self.covering[1].filter(condition)
        if len(self.sources) != 1:
            predicate = None
        return Frame(self.df.filter(condition), self.sources, self.order, predicate, self.base or self, covering)

    def over(self, uses: frozenset[str]) -> DataFrame:
        """The rows, from a covering index if there is one for the columns used."""
        if self.covering and uses <= self.covering[0]:
            return self.covering[1]
        return self.df

    def own(self) -> Frame:
        """This frame, or for a table's own one the same rows as a frame that may be extended."""
        return Frame(self.df, self.sources, self.order, length=self.length) if self.shared else self

    def extend(self, name: str, df: DataFrame) -> None:
        """The same rows with another column, which no frame shared with others has."""
        self.df, self.covering, self.tag = df, None, None


@dataclass(eq=False)
class PosVec:
    frame: Frame
    source: Source | None  # None: positions within the vector of `within`
    within: Frame | None = None


@dataclass(eq=False)
class ValVec:
    frame: Frame
    column: Column
    uses: frozenset[str]
    origin: tuple[str, str] | None = None  # (table, column) of a base column


@dataclass(eq=False)
class NumVal:
    frame: Frame
    kind: str
    column: Column
    uses: frozenset[str]
    value: int | float | None = field(default=None)
    single: bool = False
    error: str | None = None


def base_frame(table: str, version: int, df: DataFrame, rows: int | None = None, bare: DataFrame | None = None) -> Frame:
    """A frame over a table version, whose columns get a prefix of their own; `bare`: the same rows without positions."""
    prefix = f"t{next(_numbers)}_"
    source = Source(table, version, prefix)
    renamed = df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in df.columns))
    covering = None
    if bare is not None:
        covering = frozenset(prefix + c for c in bare.columns), bare.select(*(F.col(f"`{c}`").alias(prefix + c) for c in bare.columns))
    return Frame(renamed, [source], [source.pos], length=rows, covering=covering, shared=True)


def renamed(frame: Frame) -> tuple[Frame, dict[str, str]]:
    """The same rows under fresh names, for a second occurrence in one plan."""
    mark = f"r{next(_numbers)}_"
    names = {c: mark + c for c in frame.df.columns}
    sources = [Source(s.table, s.version, mark + s.prefix) for s in frame.sources]
    return Frame(frame.df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), sources, [names[c] for c in frame.order]), names


def dense(frame: Frame) -> tuple[DataFrame, int]:
    """The rows with their number in the frame's order as `__n`, and how many they are.

    Range-sorted partitions are numbered on their own and shifted by the counts of
    those before (one number per partition), so no single task sees all rows.
    """
    keys = frame.order
    df = frame.df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    df = df.withColumns({"__p": F.spark_partition_id(), "__r": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}).persist()
    counts = dict(df.groupBy("__p").count().collect())
    offsets, at = [], 0
    for p in range(max(counts, default=-1) + 1):
        offsets.append(at)
        at += counts.get(p, 0)
    starts = F.array(*(F.lit(x).cast("long") for x in offsets or [0]))
    return df.withColumn("__n", F.element_at(starts, F.col("__p") + 1) + F.col("__r")).drop("__p", "__r"), at


def evaluate(values: list[NumVal]) -> None:
    """Compute numeric values: one job for all of a frame, and for all frames of one batch. A job that fails gives its values an error."""
    todo = [v for v in values if v.value is None and v.error is None]
    groups: dict[tuple[int, bool], list[NumVal]] = {}
    for v in todo:
        groups.setdefault((id(v.frame.tag[0] if v.frame.tag else v.frame), v.single), []).append(v)
    for (_, single), vs in groups.items():
        try:
            _evaluate(vs, single)
        except FAILURES as e:
            for v in vs:
                v.error = message(e)


def _evaluate(vs: list[NumVal], single: bool) -> None:
    exprs: dict[tuple[str, str], str] = {}
    for v in vs:
        exprs.setdefault((v.kind, v.column._jc.toString()), f"a{len(exprs)}")
    made = {}
    for v in vs:
        name = exprs[v.kind, v.column._jc.toString()]
        made.setdefault(name, int32.aggregate(v.kind, v.column).alias(name))
    if vs[0].frame.tag:
        shared, tag, _ = vs[0].frame.tag
        rows = {r[tag]: r for r in _narrow(shared.df, single).groupBy(tag).agg(*made.values()).collect()}
        for v in vs:
            row = rows.get(v.frame.tag[2])
            v.value = row[exprs[v.kind, v.column._jc.toString()]] if row else {"min": int32.INT_MAX, "max": int32.INT_MIN, "sum": 0, "avg": 0.0}[v.kind]
    else:
        df = vs[0].frame.over(frozenset().union(*(v.uses for v in vs)))
        row = _narrow(df, single).agg(*made.values()).first()
        for v in vs:
            v.value = row[exprs[v.kind, v.column._jc.toString()]]


def _narrow(df: DataFrame, single: bool) -> DataFrame:
    return df.coalesce(1) if single else df
