"""Rows of a Spark query against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def both(spark, fn, sql, sf_dir, con=None):
    df = fn(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    con = con or duck(sf_dir)
    cur = con.execute(sql)
    return mine, rows([d[0] for d in cur.description], cur.fetchall())
