"""The queries that have SQL give its rows in DuckDB."""

import pytest
from compare import both, duck

from lodestar.llm import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match(spark, sf, con, name):
    mine, other = both(spark, registry.queries()[name], SQL[name], sf, con)
    assert mine == other
