"""Every registered query with a SQL twin returns the twin's rows."""

import pytest
from compare import connect, difference, rows_of_spark, rows_of_sql

from workloads.catalog import CATALOG

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n, q in CATALOG.items() if q.source])
def test_query_matches_sql(spark, duck, name):
    query = CATALOG[name]
    problem = difference(rows_of_spark(query(spark, SF_DIR)), rows_of_sql(duck, query.sql()))
    assert problem is None, problem
