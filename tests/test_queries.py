"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from check_oracles import TABLES, rows
from timedtext.plans.oracles import ORACLES
from timedtext.plans.queries import QUERIES


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sql, name):
    frame = entry.queries()[name](spark, SF_DIR)
    mine = rows(frame.columns, [tuple(r) for r in frame.collect()])
    found = sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert mine == rows(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
