"""Queries of this folder against their SQL on the smallest tables."""

import duckdb
import pytest
from conftest import SF_DIR

from check_oracles import TABLES, rows
from timedtext.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    frame = QUERIES[name](spark, SF_DIR)
    mine = rows(frame.columns, [tuple(r) for r in frame.collect()])
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(frame.columns)
    assert mine == rows(columns, found.fetchall())
