"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest
from compare import difference

from loamstone.plans import registry

QUERIES = registry.queries()
SQL = registry.oracle_sql()


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, name):
    assert difference(spark, data, QUERIES[name], SQL[name]) is None
