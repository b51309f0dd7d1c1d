"""Every query that has SQL gives the rows of its SQL at the smallest scale."""

import pytest
from compare import SMALL, duck_rows, spark_rows

from tessera.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == duck_rows(SQL[name], SMALL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
