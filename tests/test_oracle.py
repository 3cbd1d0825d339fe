"""Every registered query against its DuckDB SQL on sf0.01 (the driver's
correctness gate, run locally); rows-only queries must run and have rows."""

import os

import pytest

from oracle_check import compare, duck
from __spark_entry__ import entry, oracle_sql, queries

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
QUERIES = queries()
SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["reference", "candidate", "distance", "similarity_pct", "file_size", "rank"]
