"""Every registered query against its SQL, value by value; model queries for shape."""

import pytest

from basketlens.plans import catalog
from tests.compare import compare, connect

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def connection(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, connection, name):
    assert compare(spark, connection, name, QUERIES[name], SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_model_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry():
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
