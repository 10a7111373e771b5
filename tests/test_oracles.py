"""Every query with an oracle gives the oracle's rows at the smallest scale."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, oracle, rows_digest
from tests.conftest import SMALL

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def connection():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return db


def test_entry(spark):
    assert len(entry(spark).collect()) == 1


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, connection, name):
    df = queries()[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    names, rows, _ = oracle(connection, ORACLES[name])
    assert rows_digest(df.columns, got) == rows_digest(names, rows)
