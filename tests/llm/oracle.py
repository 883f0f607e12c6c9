"""Spark rows against DuckDB rows over the same parquet tables."""

import glob
import math
import os

import duckdb


def views(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def rows(columns, values):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(norm(r[i]) for i in by) for r in values), key=repr), sorted(columns)


def same(df, sf, sql):
    cur = views(sf).execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1] == want[1]
    assert got[0] == want[0]
