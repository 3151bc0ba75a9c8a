"""Every query with SQL against DuckDB on the smallest tables; the others must run and keep their columns."""

import pytest

from millrace import catalog_core, catalog_reference
from tests.oracle import expected, rows, views

QUERIES = {**catalog_reference.QUERIES, **catalog_core.QUERIES}
SQL = {**catalog_reference.SQL, **catalog_core.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, name):
    assert rows(QUERIES[name](spark, data)) == expected(views(data), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry_module_lists_all_queries(spark, data):
    import __spark_entry__

    known = __spark_entry__.queries()
    assert set(QUERIES) <= set(known) and set(__spark_entry__.oracle_sql()) <= set(known)
    assert __spark_entry__.entry(spark).count() > 0


def test_every_node_has_a_path_in_some_query(spark, data):
    found = QUERIES["p2_found"](spark, data).collect()
    paths = [r.id for name in ("p2_paths", "p2_looped_paths") for r in QUERIES[name](spark, data).collect()]
    assert sorted(paths) == sorted(r.id for r in found)
    assert {r.id for r in QUERIES["p2_back_edges"](spark, data).collect()} == {r.root_id for r in found if r.depth < 0}
