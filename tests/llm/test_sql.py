"""Queries with a DuckDB twin give its rows."""

import pytest

from routelens.checks.compare import compare, duck_connect
from routelens.llm.queries import QUERIES
from routelens.llm.sql import ORACLE_SQL

SF0001 = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_twin(spark, name):
    n, problems = compare(spark, duck_connect(SF0001), name, QUERIES[name], ORACLE_SQL[name], SF0001)
    assert n and not problems, problems
