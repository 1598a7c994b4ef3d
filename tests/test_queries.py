"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as contract
from check_oracle import difference, duckdb_tables
from tests.conftest import SF_DIR

QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    problem, _ = difference(QUERIES[name](spark, SF_DIR), con, ORACLE[name])
    assert problem is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 25


def test_scoring_covers_every_listing(spark, con):
    keys = con.execute("SELECT count(DISTINCT l_orderkey * 10 + l_linenumber) FROM lineitem").fetchone()[0]
    scored = QUERIES["price_scoring"](spark, SF_DIR)
    assert scored.count() == keys
    assert scored.where("predicted_price is null or predicted_price <= 0").count() == 0
