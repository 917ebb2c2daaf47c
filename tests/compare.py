"""Spark's rows against DuckDB's, as bags of rows with columns by name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir: Path):
    db = duckdb.connect()
    for p in sorted(sf_dir.glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    return db


def compare(df, sql: str, sf_dir: Path) -> int:
    """The number of rows, which are the same."""
    cursor = duck(sf_dir).execute(sql)
    columns = [c[0] for c in cursor.description]
    want = bag(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    if got != want:
        raise AssertionError(f"{sum(got.values())} rows, wanted {sum(want.values())}; too many {list((got - want).items())[:3]}; missing {list((want - got).items())[:3]}")
    return sum(want.values())
