"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from checks import registry
from checks.compare import difference, duck
from tests.conftest import SF_DIR

QUERIES = registry.QUERIES
SQL = registry.oracle_texts()
# Empty on the smallest tables.
MAY_BE_EMPTY = set()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    found = difference(QUERIES[key](spark, SF_DIR), con, SQL[key])
    assert found is None or (found == "both empty" and key in MAY_BE_EMPTY), found
