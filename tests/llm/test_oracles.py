"""The data-preparation queries that have SQL, against it, on the smallest tables."""

import pytest
from compare import difference

from loamstone.llm import oracle, queries

SQL = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    assert difference(spark, data, queries.queries()[name], SQL[name]) is None
