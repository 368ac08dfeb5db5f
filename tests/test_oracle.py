"""Every query against DuckDB over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from docloom.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    assert sorted(names) == columns
    assert {c: KINDS.get(k, k) for c, k in df.dtypes} == kinds
    assert rows == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
