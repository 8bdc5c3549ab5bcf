import pytest

from tests.oracle import SF, bag, expected
from tidewell.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    found, wanted = QUERIES[name](spark, SF).toPandas(), expected(SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert bag(found) == bag(wanted)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["o_orderkey", "o_totalprice", "c_name"]
    assert e.oracle_sql().keys() <= e.queries().keys()
