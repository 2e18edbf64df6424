"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
    return found


def mark(spark: SparkSession) -> int:
    """How many tables have been saved; see `saved`."""
    return len(getattr(spark.sparkContext, "_stratum_saved", []))


def saved(df: DataFrame, name: str, since: int | None = None, keep: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: computed once, pruned by column later, safe from lost executors.

    since: the tables saved after this mark only served this one, and are deleted
    once it is written, but for those in `keep`. Shuffle files of the writing go at
    once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    sc = spark.sparkContext
    paths = getattr(sc, "_stratum_saved", [])
    if since is not None:
        stay = {k._stratum_path for k in keep}
        _delete(sc, [x for x in paths[since:] if x not in stay])
        paths = [*paths[:since], *(x for x in paths[since:] if x in stay)]
    sc._stratum_saved = [*paths, path]
    done = spark.read.schema(df.schema).parquet(path)
    done._stratum_path = path
    return done


def _delete(sc, paths: list[str]) -> None:
    for path in paths:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> int:
    """Delete the tables that this session has saved so far, and say how many: results that still read them must have been consumed."""
    sc = spark.sparkContext
    paths = getattr(sc, "_stratum_saved", [])
    sc._stratum_saved = []
    _delete(sc, paths)
    return len(paths)
