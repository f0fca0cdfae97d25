"""Every registered query against its SQL twin, on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
duckdb = pytest.importorskip("duckdb")

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries  # noqa: E402
from tools.check import TABLES, rows, types  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMOKE_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_same_as_sql(spark, con, name):
    got = queries()[name](spark, SMOKE_DIR).toArrow()
    expected = con.sql(oracle_sql()[name]).to_arrow_table()
    assert types(got) == types(expected)
    assert rows(got) == rows(expected)


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
