"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if isinstance(v, float):
        return f"{v!r}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return f"{type(v).__name__} {v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return f"{type(v).__name__} {v}"


def rows(arrow_table) -> list[tuple]:
    names = sorted(arrow_table.column_names)
    cols = [arrow_table.column(n).to_pylist() for n in names]
    return sorted(tuple(plain(v) for v in r) for r in zip(*cols))


def differences(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    mine = spark_df.toArrow()
    theirs = con.execute(sql).to_arrow_table()
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return f"columns {sorted(mine.column_names)} vs {sorted(theirs.column_names)}"
    a, b = rows(mine), rows(theirs)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}; e.g. {[x for x in a if x not in set(b)][:2]} vs {[x for x in b if x not in set(a)][:2]}"
    if a != b:
        odd = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(odd)} of {len(a)} rows differ, e.g. {odd[:2]}"
    if not a:
        return "both empty"
    return None
