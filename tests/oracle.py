"""Runs a query and its SQL over the same tables and compares rows."""

import glob
import math
import os

import duckdb


def connect(directory: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{directory}/*.parquet"):
        source = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{source}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(v) + 0.0
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return float(v) if abs(v) < 2**53 else v
    except TypeError:
        return str(v)


def rows(names, records, order):
    at = [names.index(c) for c in order]
    return sorted((tuple(plain(r[k]) for k in at) for r in records), key=repr)


def same(df, connection, sql: str) -> None:
    made = connection.execute(sql)
    names = [d[0] for d in made.description]
    expected = made.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()], order) == rows(names, expected, order)
