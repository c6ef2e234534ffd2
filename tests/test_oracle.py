"""Every query of the library against its SQL."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference
from tillwork.plans.catalogue import QUERIES

SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, folder, con, name):
    assert difference(entry.queries()[name](spark, folder), con, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)
    assert set(QUERIES) <= set(entry.queries())


def test_entry_gives_one_row(spark):
    assert entry.entry(spark).count() == 1
