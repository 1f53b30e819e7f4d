"""Every registered query against its DuckDB text on the smallest tables."""

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect
from tablescope.queries import REGISTRY


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, sf, con, name):
    run, sql = REGISTRY[name]
    df = run(spark, sf)
    if sql is None:
        assert df.count() >= 1
    else:
        assert compare(df, con, sql) == ""


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() == 11
