"""Every registered query of the library against the SQL that states its result, on the smallest tables."""
import os

import duckdb
import pytest

from marlstone import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if v is None or isinstance(v, (bool, str)):
        return str(v)
    return f"{float(v):.9g}"


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    want = duck.sql(SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
