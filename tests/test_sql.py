"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from checks import catalog
from checks.compare import compare

# the operators for training data, a subpackage that may be absent, have tests of their own
SQL = catalog.all_sql()
QUERIES = {name: query for name, query in entry.queries().items() if name in catalog.all_queries()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    ok, message, _ = compare(spark, sf_dir, QUERIES[name], SQL.get(name))
    assert ok, message


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["grouping_id", "value", "count", "max"]
    assert frame.count() > 0
