import __spark_entry__ as entry
import pytest
from loomgraph.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, place):
    assert QUERIES[name](spark, place).columns


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "doc", "score", "rank"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
