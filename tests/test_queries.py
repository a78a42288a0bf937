"""Every registered query beside its checking SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, connect

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    state, _, _, _, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf)
    assert state in ("ok", "rows-only"), note


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
