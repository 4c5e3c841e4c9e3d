"""Every query of the library that has SQL gives the SQL's rows."""

import pytest
from compare import connect, same

import vantloom.catalogue  # noqa: F401
from vantloom.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows(spark, sf, con, name):
    df, rows = QUERIES[name](spark, sf), con.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rows.columns)
    found, want = same(df, rows)
    assert found == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_queries_without_sql_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
