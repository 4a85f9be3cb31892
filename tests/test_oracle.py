"""Every registered query against its SQL twin in DuckDB, or at least non-empty."""

import oracle
import pytest

from auricle.plans import load

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    if name in SQL:
        assert oracle.compare(spark, con, sf, QUERIES[name], SQL[name]) is None
    else:
        assert QUERIES[name](spark, sf).count() > 0
