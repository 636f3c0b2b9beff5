"""Holds a query against its SQL on DuckDB: same columns, same rows, whatever their order; floats to six places."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def sql_rows(sql: str, sf: str = SF):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.sql(sql)
    return sorted(found.columns), rows(found.columns, found.fetchall())


def check(spark, query, sql: str, sf: str = SF):
    """The number of rows that both sides have."""
    df = query(spark, sf)
    columns, expected = sql_rows(sql, sf)
    assert sorted(df.columns) == columns
    assert rows(df.columns, df.collect()) == expected
    return len(expected)
