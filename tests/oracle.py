"""Compares a query with its SQL: columns by name, rows in any order."""

from __future__ import annotations

import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return int(v) if hasattr(v, "item") and not isinstance(v, bool) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [columns[i] for i in order]


def difference(spark, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    mine, names = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    theirs, other = rows(cols, rel.fetchall())
    if names != other:
        return f"columns {names} and {other}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows, SQL has {len(theirs)}"
    return next((f"{a} but SQL has {b}" for a, b in zip(mine, theirs) if a != b), "")
