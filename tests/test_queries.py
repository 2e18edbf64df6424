"""Every registered query of the core engine against its SQL twin in DuckDB."""

import os

import duckdb
import pytest

from stratum import queries as Q

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(MEDIUM):
        con.sql(f"create view {f.split('.')[0]} as select * from '{MEDIUM}/{f}'")
    return con


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, db, name):
    df = Q.QUERIES[name](spark, MEDIUM)
    columns = sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    if name not in Q.ORACLES:
        assert got
        return
    rel = db.sql(Q.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
