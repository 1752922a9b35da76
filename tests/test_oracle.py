"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from tessera import catalog

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0 if math.isfinite(v) else str(v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    rows = df.collect()
    assert rows
    if not sql:
        return
    want = db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    places = [df.columns.index(c) for c in sorted(df.columns)]
    other = [want.columns.index(c) for c in sorted(df.columns)]
    got = sorted((tuple(plain(r[i]) for i in places) for r in rows), key=repr)
    expected = sorted((tuple(plain(r[i]) for i in other) for r in want.fetchall()), key=repr)
    assert len(got) == len(expected)
    assert got == expected
    kinds = lambda t: {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(t)
    for (c, t), i in zip(df.dtypes, [want.columns.index(c) for c in df.columns], strict=True):
        if kinds(t):
            assert str(want.types[i]) == kinds(t), c
