import pytest
from compare import assert_same

from lodestack import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_without_sql_gives_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
