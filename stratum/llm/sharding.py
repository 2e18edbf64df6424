"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised in their own order, so that minima and
maxima say something: a value's cell is its place among 255 approximate quantiles
of the dimension (of names: of their first seven bytes), which one pre-aggregated
pass over the metadata alone finds. The cells are interleaved into a Hilbert curve
index by a state machine (one fold over the bits inside whole rows), and the rows
are range-sorted by it. Runs of that order are the shards, so that each shard covers
a compact box in all dimensions and its files can be pruned by any of them.

The order is total down to the document id, so one curve cell with a third of
all rows is split over as many tasks as its size asks for. A row's place is its
number within its sorted partition plus the counts of the partitions before; the
only thing gathered is one count per partition.

Law `rows`: shard s of n holds the ranks from ceil(s * rows / n) on, so counts
are at most one apart.

Defined results: a null text has size 1 and the checksum of nothing; very long
texts count whole; null dimension values have a cell of their own (0); rows that
repeat, or have a null id, each get a slot of their own; ties on the curve are
ordered by size, checksum and id; an empty table gives an empty result; extra
columns, whatever their names, are not read by `shards` and kept by `write`.
Quantiles are approximate, so where runs of the curve end may differ between runs;
the law holds always.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import plain
from .storage import saved


@dataclass(frozen=True)
class Dimension:
    """kind: `name` for strings, `number` for numbers, dates as days or seconds."""

    column: str
    kind: str = "name"


BITS = 8
DIMENSIONS = (Dimension("lang"), Dimension("source"), Dimension("n_chars", "number"))


def states(n: int) -> tuple[list[int], list[int]]:
    """Curve digit and next state for each (state, corner), from Gray codes.

    A state is an entry corner and a direction (e * n + d). Built by rule, as the
    published compact Hilbert index does.
    """
    size, full = 1 << n, (1 << n) - 1
    gray = [w ^ w >> 1 for w in range(size)]
    inverse = {g: w for w, g in enumerate(gray)}
    ones = lambda w: (~w & (w + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    entry = [0 if w == 0 else gray[2 * ((w - 1) // 2)] for w in range(size)]
    turn = [0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n for w in range(size)]
    digit, follow = [], []
    for e in range(size):
        for d in range(n):
            k = (d + 1) % n
            for corner in range(size):
                x = corner ^ e
                w = inverse[(x >> k | x << (n - k)) & full]
                t = entry[w]
                digit.append(w)
                follow.append((e ^ (t << k | t >> (n - k)) & full) * n + (d + turn[w] + 1) % n)
    return digit, follow


def hilbert(cells: list[Column], bits: int = BITS) -> Column:
    """Hilbert index of cells of `bits` bits each, as a long."""
    n = len(cells)
    digit, follow = (F.array(*(F.lit(x) for x in t)) for t in states(n))

    def step(acc: Column, level: Column) -> Column:
        bit = [F.call_function("shiftright", F.col(f"__cell.c{j}"), level).bitwiseAND(1) * (1 << j) for j in range(n)]
        corner = bit[0]
        for b in bit[1:]:
            corner = corner + b
        at = acc["s"] * (1 << n) + corner + 1
        return F.struct((acc["h"] * (1 << n) + F.element_at(digit, at)).alias("h"), F.element_at(follow, at).alias("s"))

    levels = F.array(*(F.lit(i) for i in reversed(range(bits))))
    return F.aggregate(levels, F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s")), step, lambda acc: acc["h"])


def scale(column: Column, kind: str) -> Column:
    """A dimension value as a number in the same order."""
    if kind == "number":
        return column.cast("double")
    if kind == "name":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(column.cast("string"), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("double")
    raise ValueError(f"unknown kind of dimension: {kind}")


def cell(value: Column, bounds: list[float] | None, bits: int = BITS) -> Column:
    """Place of a value among sorted bounds, from 1, found by halving; 0 is kept for null."""
    known = F.array(*(F.lit(float(x)) for x in (bounds or [0.0])))
    size = len(bounds or [0.0])
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(bits))))
    # the count of bounds below the value: values that fill several cells begin at the first of them
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(at + step <= size, F.when(F.element_at(known, F.least(at + step, F.lit(size))) < value, at + step).otherwise(at)).otherwise(at))
    return F.when(value.isNull(), 0).otherwise(F.least(found + 1, F.lit((1 << bits) - 1)))


def quantiles(docs: DataFrame, dimensions: tuple[Dimension, ...], bits: int = BITS) -> list[list[float] | None]:
    """Bounds of the cells of each dimension: 254 numbers at most, in one pass."""
    cells = (1 << bits) - 1
    shares = [k / cells for k in range(1, cells)]
    found = docs.agg(*(F.percentile_approx(scale(F.col(f"`{d.column}`"), d.kind), shares).alias(f"q{k}") for k, d in enumerate(dimensions))).first()
    return [list(q) if q else None for q in found]


def _ranked(docs: DataFrame, dimensions: tuple[Dimension, ...], id_col: str, text_col: str, n: int, rows: DataFrame, names: list[str], more: list[str]) -> DataFrame:
    """Rows with doc_id, size, text_crc32, curve, shard and slot, and the columns `more`, by one range sort."""
    at = dict(zip(docs.columns, names, strict=True))
    text = F.coalesce(F.col(at[text_col]).cast("string"), F.lit(""))
    bounds = quantiles(docs, dimensions)
    cells = F.struct(*(cell(scale(F.col(at[d.column]), d.kind), b).alias(f"c{j}") for j, (d, b) in enumerate(zip(dimensions, bounds, strict=True))))
    src = rows.select(F.col(at[id_col]).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), cells.alias("__cell"), *more)
    src = src.select("doc_id", "size", "text_crc32", hilbert([F.col(f"__cell.c{j}") for j in range(len(dimensions))]).alias("curve"), *more)
    order = ["curve", "size", "text_crc32", "doc_id"]
    ordered = src.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = saved(ordered.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "curve")
    counts = ordered.groupBy("part").agg(F.count("*").alias("rows"))  # one row per partition
    everything = Window.partitionBy().orderBy("part")
    counts = counts.select("part", (F.sum("rows").over(everything) - F.col("rows")).alias("before"), F.sum("rows").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    ranked = ordered.join(counts, "part").withColumn("rank", F.col("before") + F.col("row"))
    placed = ranked.withColumn("shard", F.expr(f"(rank * {n}) div total").cast("int"))
    return placed.withColumn("slot", F.col("rank") - F.expr(f"(shard * total + {n - 1}) div {n}"))


def shards(docs: DataFrame, n: int = 8, dimensions: tuple[Dimension, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    rows, names = plain(docs, *docs.columns)
    placed = _ranked(docs, dimensions, id_col, text_col, n, rows, names, [])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def write(docs: DataFrame, path: str, n: int = 8, dimensions: tuple[Dimension, ...] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> None:
    """Write all rows, whole, as directories of shards, each in curve order; the rows themselves are carried through the ordering. `shard_col` names the directories and must not be a column."""
    if shard_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {shard_col} already")
    rows, names = plain(docs, *docs.columns)
    placed = _ranked(docs, dimensions, id_col, text_col, n, rows, names, names)
    placed = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    placed.select(*names, "shard").toDF(*docs.columns, shard_col).write.partitionBy(shard_col).parquet(path)
