"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest
from oracle import connect, same

from tallyloom.plans.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    same(QUERIES[name](spark, DIR), con.sql(ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
