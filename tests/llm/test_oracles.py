"""The queries of the operators that have SQL, against DuckDB."""

import duckdb
import pytest

from smoothlake.llm import entry


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    at = "/root/testdata/sf0.01"
    got = entry.queries()[name](spark, at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == rows and rows
