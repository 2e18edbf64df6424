"""Immutable table versions in parquet.

Rows carry the number of the partition that wrote them and their place in it;
the catalog has the offsets of partitions, one number each. A position is then
an expression over two stored columns: writing needs no second pass and no
global numbering, and appending rows adds files without touching the others.
"""

from __future__ import annotations

import csv
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StatementError
from .catalog import Catalog, Segment, Table, Version

PART, ROW, POS = "__part", "__row", "__pos"

#: Most segments of a version; beyond it, the last ones become one.
MOST_SEGMENTS = 16


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumns({PART: F.spark_partition_id(), ROW: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})


def write_segment(catalog: Catalog, table: Table, df: DataFrame) -> Segment:
    """Write rows in the order of their partitions."""
    path = catalog.fresh(table.name)
    _numbered(df.select(*(F.col(f"`{c}`").cast("int").alias(c) for c in table.columns))).write.parquet(path)
    counts = {r[PART]: r["n"] for r in df.sparkSession.read.parquet(path).groupBy(PART).agg(F.count("*").alias("n")).collect()}
    offsets, at = [], 0
    for part in range(max(counts, default=-1) + 1):
        offsets.append(at)
        at += counts.get(part, 0)
    return Segment(path, offsets, at)


def schema(table: Table) -> str:
    return ", ".join(f"`{c}` int" for c in table.columns)


def raw_segment(spark: SparkSession, table: Table, segment: Segment) -> DataFrame:
    """The rows as stored, with partition and place."""
    return spark.read.schema(f"{schema(table)}, {PART} int, {ROW} long").parquet(segment.path)


def read_segment(spark: SparkSession, table: Table, segment: Segment, base: int) -> DataFrame:
    df = raw_segment(spark, table, segment)
    if len(segment.offsets) <= 1:
        pos: Column = F.lit(base) + F.col(ROW)
    else:
        starts = F.array(*(F.lit(base + x).cast("long") for x in segment.offsets))
        pos = F.element_at(starts, F.col(PART) + 1) + F.col(ROW)
    return df.select(*table.columns, pos.cast("long").alias(POS))


def read_version(spark: SparkSession, table: Table, version: Version | None = None) -> DataFrame:
    """All columns of a version and the position of each row."""
    if version is None and table.external is not None:
        # not cast: comparisons then reach the scan; what is shown or written is cast, which raises beyond 32 bits
        return spark.read.parquet(table.external).select(*table.columns, F.col("_metadata.row_index").alias(POS))
    version = version or table.version
    out, base = None, 0
    for s in version.segments:
        part = read_segment(spark, table, s, base)
        out = part if out is None else out.unionByName(part)
        base += s.rows
    if out is None:
        out = spark.createDataFrame([], f"{schema(table)}, {POS} long")
    return out


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Range-sorted over all partitions: what a clustered layout is, and what min/max statistics skip by."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def build_index(catalog: Catalog, table: Table, df: DataFrame, column: str) -> str:
    """A sorted projection (value, position)."""
    path = catalog.fresh(f"{table.name}.{column}")
    ordered(df.select(column, POS), column, POS).write.parquet(path)
    return path


def compacted(catalog: Catalog, spark: SparkSession, table: Table, segments: list[Segment]) -> list[Segment]:
    """At most MOST_SEGMENTS with the same rows at the same positions.

    The longest tail becomes one segment whose first member has at most four times the
    rows of the others together, so that a row is written again only a few times.
    """
    if len(segments) <= MOST_SEGMENTS:
        return segments
    after = [sum(s.rows for s in segments[i + 1 :]) for i in range(len(segments))]
    at = next((i for i, s in enumerate(segments[:-1]) if s.rows <= 4 * after[i]), len(segments) - 2)
    tail = read_version(spark, table, Version(segments[at:]))
    return [*segments[:at], write_segment(catalog, table, ordered(tail, POS))]


def publish(catalog: Catalog, spark: SparkSession, table: Table, segments: list[Segment], logged: int | None = None) -> None:
    """Make segments the current version, with its indexes; `logged`: the last journal entry that it has."""
    segments = compacted(catalog, spark, table, segments)
    version = Version(segments)
    df = read_version(spark, table, version)
    for column, (_, clustered) in table.index.items():
        if not clustered and version.rows:
            version.indexes[column] = build_index(catalog, table, df, column)
    table.version, table.external = version, None
    if logged is not None:
        table.logged = logged
    table.number += 1
    catalog.save()


def rewrite(catalog: Catalog, table: Table, df: DataFrame, logged: int | None = None) -> None:
    """A whole new version from rows with positions; order is kept, or made that of the clustered column."""
    keys = [table.clustered, POS] if table.clustered else [POS]
    publish(catalog, df.sparkSession, table, [write_segment(catalog, table, ordered(df, *keys))], logged)


def replace_values(catalog: Catalog, spark: SparkSession, table: Table, change: Callable[[DataFrame], DataFrame]) -> None:
    """A new version whose rows keep their positions: written file by file, without a shuffle or a count."""
    segments = []
    for s in table.version.segments:
        path = catalog.fresh(table.name)
        change(raw_segment(spark, table, s)).select(*table.columns, PART, ROW).write.parquet(path)
        segments.append(Segment(path, s.offsets, s.rows))
    publish(catalog, spark, table, segments)


def append(catalog: Catalog, table: Table, rows: DataFrame, logged: int | None = None) -> None:
    """Rows after the existing ones; a clustered table is merged, others only grow by files."""
    spark = rows.sparkSession
    if table.external is not None:
        rewrite(catalog, table, read_version(spark, table))
    if not table.clustered:
        publish(catalog, spark, table, [*table.version.segments, write_segment(catalog, table, rows)], logged)
        return
    segment = write_segment(catalog, table, rows)
    rewrite(catalog, table, read_version(spark, table, Version([*table.version.segments, segment])), logged)


def load_csv(catalog: Catalog, spark: SparkSession, path: str) -> Table:
    """A CSV file whose header names all columns of one table, in order, as db.table.column."""
    lines = [r.value for r in spark.read.text(path).limit(1).collect()]
    if not lines:
        raise StatementError(f"No header in {path}.")
    header = next(csv.reader([lines[0].strip()]))
    table, _ = catalog.column(header[0].strip())
    table.complete()
    if [h.strip() for h in header] != [f"{catalog.db}.{table.name}.{c}" for c in table.columns]:
        raise StatementError("The header must name all columns of the table in order.")
    rows = spark.read.schema(schema(table)).option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
    append(catalog, table, rows)
    return table


def register(catalog: Catalog, name: str, df: DataFrame) -> Table:
    """Integer columns of a DataFrame as a table; values beyond 32 bits are an error (ANSI cast)."""
    table = Table(name, len(df.columns), list(df.columns))
    catalog.tables[name] = table
    append(catalog, table, df.select(*(F.expr(f"cast(`{c}` as int)").alias(c) for c in df.columns)))
    return table


def attach(catalog: Catalog, spark: SparkSession, name: str, path: str, columns: list[str]) -> Table:
    """Integer columns of a single parquet file as a table, read in place: positions are its row numbers."""
    if len(spark.read.parquet(path).inputFiles()) != 1:
        raise StatementError("Only a single file can be attached; register it instead.")
    catalog.tables[name] = Table(name, len(columns), list(columns), external=path)
    catalog.save()
    return catalog.tables[name]


def without_positions(spark: SparkSession, table: Table) -> DataFrame | None:
    """The rows of an attached table for work that needs no positions (row numbers cannot be pruned from a scan)."""
    return spark.read.parquet(table.external).select(*table.columns) if table.external is not None else None


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, for tables that need not last."""
    top = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{top.rstrip('/')}/tables-{uuid.uuid4().hex}"
