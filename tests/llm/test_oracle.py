"""Registered queries with SQL give the SQL's rows."""

import os

import duckdb
import pytest

from inkveil.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    want = con.sql(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in df.collect()) == sorted(want.fetchall())
