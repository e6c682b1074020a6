"""Every registered query equals its DuckDB twin on sf0.001 (the driver checks sf0.01)."""

import pytest

import __spark_entry__ as E
from routelens.checks.compare import compare, duck_connect
from routelens.plans import all_queries
from tests.conftest import SF0001

QUERIES = {name: fn for name, fn in E.queries().items() if name in all_queries()}
SQL = {name: sql for name, sql in E.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF0001)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    n, problems = compare(spark, con, name, QUERIES[name], SQL[name], SF0001)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_query_runs(spark, name):
    assert QUERIES[name](spark, SF0001).count() >= 0


def test_entry_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["eval_name", "model", "performance", "total_cost_pico"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    """An oracle without its query means a registered query was lost."""
    from routelens.checks.oracle_sql import ORACLE_SQL
    assert set(ORACLE_SQL) <= set(QUERIES), sorted(set(ORACLE_SQL) - set(QUERIES))
