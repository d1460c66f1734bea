"""Queries that SQL can state, against DuckDB."""

import os
from collections import Counter

import duckdb
import pytest

from docloom.llm import queries

from .helpers import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    found = con.sql(queries.ORACLE_SQL[name])
    rows = queries.QUERIES[name](spark, SF).select(*found.columns).collect()
    assert Counter(map(tuple, rows)) == Counter(found.fetchall()) and rows


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
