"""The queries with SQL give the same rows in DuckDB on the small tables."""

import os

import duckdb
import pytest

from motleydex.llm import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    df = catalog.queries()[name](spark, data)
    rel = con.sql(SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [list(rel.columns).index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_the_others_run(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0
