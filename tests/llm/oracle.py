"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def tables(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def same(df, sql, folder):
    got = df.collect()
    res = tables(folder).execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda r: tuple(str(x) for x in r)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in got), key=key)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in res.fetchall()), key=key)
    assert mine == theirs
    return len(mine)
