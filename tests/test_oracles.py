import pytest
from oracle import compare, connect

from leadloom import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, con, name):
    assert compare(spark, con, SF, registry.QUERIES[name], registry.ORACLES[name]) > 0


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
