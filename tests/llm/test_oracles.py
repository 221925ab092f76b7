"""The subpackage's queries with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from framelight.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{table}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
