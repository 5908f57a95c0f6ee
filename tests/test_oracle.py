import compare
import pytest

from silkgraph.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connection(SMALL)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_oracle(spark, con, name):
    assert compare.check(name, QUERIES[name], ORACLES[name], spark, SMALL, con) is None
