import pytest

from tests.oracle import compare, connect
from voxloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    assert compare(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name]) == ""
