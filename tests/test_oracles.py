import pytest

from tessera.plans.registry import QUERIES, SQL
from tests.compare import differences, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    assert not differences(spark, con, sf, QUERIES[name], SQL[name])
