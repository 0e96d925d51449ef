import pytest

from archivum.llm import queries
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, spark, sf, duck):
    check(name, queries.QUERIES[name], queries.ORACLES[name], spark, sf, duck)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(name, spark, sf):
    df = queries.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
