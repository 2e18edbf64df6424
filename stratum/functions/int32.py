"""32-bit integer semantics as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def wrap(x: Column) -> Column:
    """A long brought back to 32 bits in two's complement (ANSI casts would raise instead)."""
    return F.shiftright(F.shiftleft(x, 32), 32).cast("int")


def add(a: Column, b: Column) -> Column:
    return wrap(a.cast("long") + b)


def sub(a: Column, b: Column) -> Column:
    return wrap(a.cast("long") - b)


def in_range(x: Column, low: int | None, high: int | None) -> Column | None:
    """low <= x < high with open ends; None if it always holds."""
    parts = ([x >= F.lit(low)] if low is not None else []) + ([x < F.lit(high)] if high is not None else [])
    return parts[0] & parts[1] if len(parts) == 2 else parts[0] if parts else None


def aggregate(kind: str, x: Column) -> Column:
    """min, max, sum and avg, with the identities of the empty input: INT_MAX, INT_MIN, 0 and 0.0."""
    if kind == "min":
        return F.coalesce(F.min(x).cast("int"), F.lit(INT_MAX))
    if kind == "max":
        return F.coalesce(F.max(x).cast("int"), F.lit(INT_MIN))
    total = F.coalesce(F.sum(x.cast("long")), F.lit(0).cast("long"))
    if kind == "sum":
        return total
    if kind == "avg":
        return F.when(F.count(x) == 0, F.lit(0.0)).otherwise(total.cast("double") / F.count(x))
    raise ValueError(f"unknown aggregate: {kind}")
