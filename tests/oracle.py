"""Run a query in Spark and its SQL in DuckDB on the same tables and compare the rows, in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return float(v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(table: list[dict]) -> list[tuple]:
    return sorted((tuple(plain(r[k]) for k in sorted(r)) for r in table), key=repr)


def compare(spark, query, sql: str, folder: str) -> str | None:
    """None if both give the same rows; else what differs first."""
    df = query(spark, folder)
    cur = connect(folder).execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a = rows([r.asDict(recursive=True) for r in df.collect()])
    b = rows([dict(zip(names, r)) for r in cur.fetchall()])
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2] if len(a) < 200_000 else []
        return f"{len(a)} and {len(b)} rows {extra}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} and {y}"
    return None
