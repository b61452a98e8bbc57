"""Compares a query with its SQL on the same tables, as the driver does."""

import math
import os

import duckdb


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (int, float)):
        return f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{sf_dir}/{t}'")
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want = rows_of([c[0] for c in rel.description], rel.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
