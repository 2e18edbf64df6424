"""insert, delete and update as new table versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StatementError
from ..plans.frame import PosVec
from ..sources import storage
from ..sources.catalog import Catalog, Table
from .vectors import positions


def insert(catalog: Catalog, spark: SparkSession, table: Table) -> None:
    """The table's waiting rows after all others, or, in a clustered table, after those of an equal key."""
    rows = catalog.pending.get(table.name)
    if rows:
        storage.append(catalog, table, spark.createDataFrame(rows, storage.schema(table)).coalesce(1), catalog.entry)
        catalog.settle(table)


def _plain(table: Table, p: PosVec) -> bool:
    """Whether p is a plain filter over the current version, which needs no join to mark its rows."""
    s = p.source
    return p.frame.predicate is not None and s is not None and (s.table, s.version) == (table.name, table.number)


def _hit(df: DataFrame, p: PosVec) -> DataFrame:
    """The rows with a column that says whether p's filter holds."""
    prefix = p.source.prefix
    marked = df.select(*(F.col(f"`{c}`").alias(prefix + c) for c in df.columns)).withColumn("__hit", F.coalesce(p.frame.predicate, F.lit(False)))
    return marked.select(*(F.col(prefix + c).alias(c) for c in df.columns), "__hit")


def _marked(spark: SparkSession, table: Table, p: PosVec) -> DataFrame:
    """The current rows with a column that says whether p has their position."""
    df = storage.read_version(spark, table)
    if _plain(table, p):
        return _hit(df, p)
    at = positions(p)
    hits = p.frame.df.select(F.col(at).alias(storage.POS)).distinct().withColumn("__hit", F.lit(True))
    return df.join(hits, storage.POS, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def delete(catalog: Catalog, spark: SparkSession, table: Table, p: PosVec) -> None:
    """Without the rows at the positions of p; the others close up."""
    storage.rewrite(catalog, table, _marked(spark, table, p).where("not __hit").drop("__hit"))


def update(catalog: Catalog, spark: SparkSession, table: Table, column: str, p: PosVec, value: int) -> None:
    """One column set to a value at the positions of p."""
    if not -(2**31) <= value < 2**31:
        raise StatementError(f"Value out of range: {value}.")
    change = lambda df: df.withColumn(column, F.when(F.col("__hit"), F.lit(value)).otherwise(F.col(f"`{column}`"))).drop("__hit")
    if _plain(table, p) and table.external is None and column != table.clustered:
        storage.replace_values(catalog, spark, table, lambda df: change(_hit(df, p)))
    else:
        storage.rewrite(catalog, table, change(_marked(spark, table, p)))
