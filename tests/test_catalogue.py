"""Registered queries against DuckDB on sf0.001."""

import pytest
from compare import compare, oracle

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, con, name):
    assert compare(spark, con, name, catalogue.queries()[name], catalogue.oracle_sql()[name], SF) == ""
