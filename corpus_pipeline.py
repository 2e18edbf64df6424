"""The corpus pipeline: five stages over `documents`, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept. All but the last return the columns of documents; the last
returns one row per packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratum.llm import near_dedup, packing, pii, quality_rules, substring_dedup
from stratum.llm.storage import mark, saved
from stratum.shipping import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    ship(spark)
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents of similarity 0.8 or more on five-word shingles, one stays."""
    ship(spark)
    return near_dedup.keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents are cut out of all but the first."""
    ship(spark)
    return substring_dedup.cut(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal it, are generalised."""
    ship(spark)
    return pii.sanitise(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """The remaining texts as token sequences."""
    ship(spark)
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, tokenizer)


STAGES = [("quality_rules", quality), ("near_dedup", near_duplicates), ("substring_dedup", substrings), ("pii", personal_data), ("packing", sequences)]

#: Connected components, MinHash and tokenization are beyond SQL; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark(spark)
    for name, stage in STAGES[:-1]:
        # once a stage is written, its own tables and its predecessor's rows have served
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}", since=begun)
    return STAGES[-1][1](spark, docs, sf_dir)
