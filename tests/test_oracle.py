"""Every registered query against its SQL in DuckDB, row by row, at the smallest scale."""

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from docloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def plain(v):
    return round(float(v), 6) if isinstance(v, float | Decimal) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert rows
    if name in registry.ORACLE_SQL:
        found = tables.sql(registry.ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert rows == Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
