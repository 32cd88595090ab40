"""Every registered query of the library against its SQL, or for rows and a repeated run where SQL has none."""

import pytest
from oracle import SF, same, views

from caselake import plans, registry  # noqa: F401


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLES:
        same(got.toPandas(), con.sql(registry.ORACLES[name]).df())
    else:
        assert got.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, registry.QUERIES[name](spark, SF).collect()))


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
