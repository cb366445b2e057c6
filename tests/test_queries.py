"""Every registered query against its SQL on the smallest tables; the entry and the registry itself."""

import pytest

import __spark_entry__ as entry
from parity import connection, spark_rows, sql_rows

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    got, want = spark_rows(entry.queries()[name](spark, sf)), sql_rows(con, ORACLE[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in ORACLE))
def test_query_without_sql_runs(spark, sf, name):
    rows = entry.queries()[name](spark, sf).collect()
    assert len(rows) == len(set(map(repr, rows)))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
