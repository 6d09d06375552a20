"""Every query with an SQL form gives the same rows in DuckDB."""

import pytest

import __spark_entry__ as entry
from suite.compare import connect, difference

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, duck, name):
    assert difference(QUERIES[name](spark, small), duck, SQL[name]) is None


def test_entry(spark, small):
    rows = entry.entry(spark)
    assert rows.columns == ["keyword", "tfidf_weight"]
    assert rows.count() > 0
