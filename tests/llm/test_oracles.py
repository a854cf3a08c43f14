"""Registered queries of the training-data operators against DuckDB on sf0.001."""

import pytest
from compare import compare, oracle

from millrace.llm import queries
from millrace.llm.oracles import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    assert compare(spark, con, name, queries.queries()[name], ORACLE[name], SF) == ""
