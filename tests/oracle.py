"""Runs a query and its SQL side by side."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    table = con.execute(sql).to_arrow_table()
    names = sorted(table.column_names)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in table.to_pylist()), key=repr)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in (x.asDict(recursive=True) for x in df.collect())), key=repr)
