"""The registered queries: names, and those that SQL can express against DuckDB."""

import os

import duckdb
import public_tokenizers
import pytest

from stratum.llm import queries as Q
from stratum.llm.unigram import decode_ids

MEDIUM = "/root/testdata/sf0.01"


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in Q.QUERIES} == {f"op{i}" for i in range(1, 11)}


@pytest.mark.parametrize("name", list(Q.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(MEDIUM):
        con.sql(f"create view {f.split('.')[0]} as select * from '{MEDIUM}/{f}'")
    df = Q.QUERIES[name](spark, MEDIUM)
    columns = sorted(df.columns)
    rel = con.sql(Q.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_op6_returns_what_decodes_to_the_texts(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    back = decode_ids(Q.QUERIES["op6_sentencepiece"](spark, MEDIUM), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(back) == len(text) and {r.doc_id: r.text for r in back} == text
