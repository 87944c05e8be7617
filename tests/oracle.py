"""Runs a query and its SQL over the same tables and compares values, order aside."""

from __future__ import annotations

import datetime
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v) -> str:
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def both(df, con, sql: str) -> tuple[list[str], list[str]]:
    cols = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in cols) for r in df.collect())
    result = con.sql(sql)
    assert sorted(result.columns) == cols
    at = [result.columns.index(c) for c in cols]
    return got, sorted("|".join(plain(r[i]) for i in at) for r in result.fetchall())
