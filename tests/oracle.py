"""Compares a Spark query with its DuckDB SQL, row by row, whatever the order."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    return _rows([d[0] for d in got.description], got.fetchall())


def spark_rows(df):
    return _rows(df.columns, df.collect())


def differences(df, sf_dir: str, sql: str) -> str:
    """Empty if both give the same rows."""
    (a, x), (b, y) = spark_rows(df), duck(sf_dir, sql)
    if a != b:
        return f"columns {a} against {b}"
    only_x, only_y = x - y, y - x
    return "" if not only_x and not only_y else f"{sum(x.values())} against {sum(y.values())} rows; {list(only_x)[:2]} against {list(only_y)[:2]}"
