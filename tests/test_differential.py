"""Every query that has SQL gives the rows of that SQL in DuckDB; the others run."""

import pytest
from compare import both, duck

from lodestar import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match(spark, sf, con, name):
    mine, other = both(spark, QUERIES[name], SQL[name], sf, con)
    assert mine[0] == other[0]
    assert len(mine[1]) == len(other[1])
    assert mine[1] == other[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns
