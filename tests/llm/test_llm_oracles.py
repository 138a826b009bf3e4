"""Registered queries of the subpackage against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from tallyline.llm import queries as registered

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = registered.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(registered.oracle_sql()[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=str)
