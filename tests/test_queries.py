"""Every registered query against DuckDB on the smallest supplied tables."""

import pytest
from compare import differences, open_tables

import __spark_entry__ as contract

FOLDER = "/root/testdata/sf0.001"
# Those of the optional subpackage have tests of their own.
QUERIES = {n: f for n, f in contract.queries().items() if n not in contract.LLM_QUERIES}
SQL = {n: s for n, s in contract.oracle_sql().items() if n not in contract.LLM_SQL}


@pytest.fixture(scope="module")
def connection():
    return open_tables(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert differences(df, connection, SQL[name]) == []
    else:
        assert df.count() > 0


def test_only_sketches_go_without_sql():
    assert set(QUERIES) - set(SQL) == {"estimated_users", "estimated_price_quantiles"}


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["event_id", "ts", "user_id", "event_type", "value", "k"]
    assert df.count() > 0
