"""Every registered key against its DuckDB oracle on the smallest data set."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from stockspark.plans.compare import compare, duckdb_connection
from stockspark.plans.oracle import oracle_sql
from stockspark.plans.registry import QUERIES

from .conftest import SMOKE_DIR

KEYS = sorted(QUERIES)
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SMOKE_DIR)


def test_every_key_has_an_oracle_or_is_rows_only():
    rows_only = set(KEYS) - set(SQL)
    assert rows_only == set()
    assert set(SQL) <= set(KEYS)


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["category", "item_count", "total_stock", "total_value"]


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SMOKE_DIR)
    if key not in SQL:
        assert df.count() >= 0
        return
    res = compare(df, con, SQL[key])
    assert res["columns_match"], res
    assert res["values_match"], res
