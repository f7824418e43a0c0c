import pytest

from nestwright.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, small, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], small)
