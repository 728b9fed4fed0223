"""Every registered query with SQL gives the same names, rows and values as DuckDB."""

import pytest

import __spark_entry__ as entry
import oracle

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# states that need the larger tables to occur
MAY_BE_EMPTY = {"stream_usage", "verify_outcomes", "purge_set"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    problem = oracle.compare(spark, con, QUERIES[name], SQL.get(name), sf_dir)
    if problem in ("both sides empty", "no rows") and name in MAY_BE_EMPTY:
        return
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).columns == ["version_id", "domain", "always"]
