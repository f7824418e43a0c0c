import pytest

from nestwright import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, small, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], small)
