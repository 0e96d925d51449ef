import pytest

from archivum.queries import problems, registry
from tests.oracle import check

ALL = registry.QUERIES | problems.QUERIES
SQL = registry.ORACLES | problems.ORACLES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf, duck):
    check(name, ALL[name], SQL[name], spark, sf, duck)


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf):
    df = ALL[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
