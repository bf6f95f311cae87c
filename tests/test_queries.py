"""Every registered query with SQL against DuckDB, on the smallest tables; the others give rows."""

import pytest
from compare import connect, difference

from depthframe.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(testdata):
    return connect(f"{testdata}/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, testdata, con, name):
    if name in ORACLES:
        assert difference(spark, con, f"{testdata}/sf0.001", QUERIES[name], ORACLES[name]) is None
    else:
        assert QUERIES[name](spark, f"{testdata}/sf0.001").count() > 0
