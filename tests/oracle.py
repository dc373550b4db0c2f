"""Compares a query with its DuckDB oracle: names, types and rows in any order."""

import math
import os

import duckdb

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: None if v is None else round(v, 5) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(tidy(r[i]) for i in order) for r in data), key=repr)


def assert_same(df, connection, sql):
    want = connection.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())
