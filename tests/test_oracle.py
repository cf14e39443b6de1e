"""Every registered query against its SQL statement on the small tables."""

import pytest

from conftest import SF_SMALL
from oracle import compare, connect
from __spark_entry__ import entry, oracle_sql, queries

# the corpus operators have tests of their own
QUERIES = {name: fn for name, fn in queries().items() if fn.__wrapped__.__module__.startswith("lorewell.plans")}
SQL = {name: sql for name, sql in oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, name, QUERIES[name], SQL.get(name), SF_SMALL)
    assert ok, note


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0
