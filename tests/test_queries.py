"""Every registered query runs; those with SQL give its values."""

from __future__ import annotations

import pytest

from factloom.plans import catalog
from tests.oracle import both, connection

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf_dir, con):
    df = catalog.queries()[name](spark, sf_dir)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.columns and not df.isEmpty()  # tests/test_repairs.py and tests/test_operators.py hold the values
    else:
        got, expected = both(df, con, sql)
        assert got == expected
