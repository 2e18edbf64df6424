"""Rows with any column names: worked on under plain ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def plain(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """The rows with columns c0, c1, ..., whatever their names were (dots, clashes), and the new names of the wanted ones.

    `docs.columns` gives the old names back: `done.toDF(*docs.columns)`.
    """
    names = docs.columns
    return docs.toDF(*(f"c{i}" for i in range(len(names)))), [f"c{names.index(w)}" for w in wanted]


def fields(df: DataFrame, *more: StructField) -> StructType:
    """Schema of the rows after the columns `more`."""
    return StructType([*more, *df.schema.fields])


def with_text(done: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Rows of `plain(docs)` after a column `text`, which replaces their own text; n_chars, where there is one, is made to fit."""
    out = []
    for i, f in enumerate(docs.schema.fields):
        made = F.col("text") if f.name == text_col else F.char_length("text").cast(f.dataType) if f.name == "n_chars" else F.col(f"c{i}")
        out.append(made.alias(f"c{i}"))
    return done.select(*out).toDF(*docs.columns)
