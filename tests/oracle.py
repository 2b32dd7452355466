"""Runs registered queries beside their SQL in DuckDB and compares rows."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(v):
    """A value as both engines give it, for comparison."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(0.0 if v == 0 else v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime | datetime.date):
        return v.isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(str, map(plain, v))) + "]"
    return str(v)


def tables(folder: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"create view {p.stem} as select * from '{source}'")
    return con


def difference(df, con, sql: str) -> str:
    """What differs between a DataFrame and the SQL's rows; empty if nothing does."""
    names = sorted(df.columns)
    found = con.sql(sql)
    if sorted(found.columns) != names:
        return f"columns {names} and {sorted(found.columns)}"
    mine = Counter(tuple(map(plain, r)) for r in df.select(*names).collect())
    own = [found.columns.index(n) for n in names]
    theirs = Counter(tuple(plain(r[i]) for i in own) for r in found.fetchall())
    if mine == theirs:
        return ""
    return f"{sum(mine.values())} and {sum(theirs.values())} rows; only mine {list((mine - theirs).items())[:3]}, only theirs {list((theirs - mine).items())[:3]}"
