import pytest

from millrace.llm import catalog
from tests.oracle import expected, rows, views


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, data, name):
    assert rows(catalog.QUERIES[name](spark, data)) == expected(views(data), catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0
