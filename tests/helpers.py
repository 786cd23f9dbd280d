"""Comparison helpers shared by the tests."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

GENERATED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def duck_on_generated(sf_dir: str):
    con = duckdb.connect()
    for t in GENERATED:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    names = [cols[i].lower() for i in order]
    return names, sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return canon(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    res = con.execute(sql)
    return canon([d[0] for d in res.description], res.fetchall())


def assert_same(spark_result, duck_result, key=""):
    s_cols, s_rows = spark_result
    d_cols, d_rows = duck_result
    assert s_cols == d_cols, f"{key}: columns {s_cols} != {d_cols}"
    assert len(s_rows) == len(d_rows), f"{key}: {len(s_rows)} rows != {len(d_rows)}"
    for a, b in zip(s_rows, d_rows):
        assert a == b, f"{key}: spark {a} != duck {b}"
