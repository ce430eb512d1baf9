"""The subpackage's queries against the SQL that states their results, on the smallest tables."""
import duckdb
import pytest

from marlstone.llm import queries

QUERIES, SQL = queries.queries(), queries.sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got, want = QUERIES[name](spark, small), con.sql(SQL[name])
    at = [want.columns.index(c) for c in got.columns]
    assert len(at) == len(want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
