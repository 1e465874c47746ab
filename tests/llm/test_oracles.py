"""The queries that SQL can express, against that SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from touchline.llm import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "embeddings"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    wanted = con.sql(oracle_sql()[name])
    found = queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    rows = lambda r: sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in x) for x in r), key=str)
    assert rows(found.select(*columns).collect()) == rows(wanted.select(*columns).fetchall())
