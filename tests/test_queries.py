"""Every registered query against its SQL on the smallest tables."""
import pytest

from statuta import plans
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, FOLDER, QUERIES, ORACLES)
    assert ok, message
