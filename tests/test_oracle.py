"""Every registered query with an SQL twin gives its rows at the smallest scale; the others give rows."""

import pytest

from groundspark.plans import registry
from tests.compare import database, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, con, name):
    same(registry.QUERIES[name](spark, SF), con, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.head(1)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
