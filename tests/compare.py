"""Runs a query's SQL in DuckDB and compares rows, whatever their order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF_DIR = "/root/testdata/sf0.001"


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "item"):
        v = v.item()
    return float(v) if isinstance(v, int | float) else str(v)


def oracle_rows(sql: str, sf_dir: str = SF_DIR) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return names, cursor.fetchall()


def as_set(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([names[i] for i in order], [_plain(r[i]) for i in order]).__repr__() for r in rows)


def same(df, sql: str, sf_dir: str = SF_DIR) -> bool:
    names, rows = oracle_rows(sql, sf_dir)
    return as_set(df.columns, [tuple(r) for r in df.collect()]) == as_set(names, rows)
