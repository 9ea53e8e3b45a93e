"""Every query that has SQL gives DuckDB's rows over the smallest tables."""

import pytest
from conftest import SMALL, same_rows

from larkspur.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SMALL), duck.sql(SQL[name]))
