"""Run queries on Spark and their SQL on DuckDB, and compare the rows as multisets."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def _plain(v):
    if isinstance(v, list):
        return tuple(_plain(x) for x in v)
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def difference(spark_df, con, sql: str) -> str:
    got_cols = spark_df.columns
    got = rows_of(got_cols, spark_df.collect())
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = rows_of(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    if got != want:
        extra, missing = got - want, want - got
        return f"{sum(got.values())} rows vs {sum(want.values())}; extra {list(extra)[:3]}; missing {list(missing)[:3]}"
    return ""
