import pytest

from quillon import registry
from tests.oracle import check

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    check(registry.queries()[name](spark, data), SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert registry.queries()[name](spark, data).count() > 0
