"""Runs a registered query and its checking SQL side by side and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import time
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in os.listdir(folder):
        if file.endswith(".parquet"):
            con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{file}'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def compare(spark, con, name, query, sql, folder) -> dict:
    start = time.time()
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = Counter(tuple(_cell(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    spent = time.time() - start
    out = {"name": name, "rows": sum(mine.values()), "sec": round(spent, 2)}
    if sql is None:
        return out | {"ok": None}
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return out | {"ok": False, "why": f"columns {columns} vs {sorted(names)}"}
    order = [names.index(c) for c in columns]
    theirs = Counter(tuple(_cell(row[i]) for i in order) for row in cursor.fetchall())
    out["oracle_rows"] = sum(theirs.values())
    if mine == theirs:
        return out | {"ok": True}
    return out | {
        "ok": False,
        "why": f"{columns}\n   only spark {sum((mine - theirs).values())}: {list((mine - theirs).items())[:2]}\n   only sql {sum((theirs - mine).values())}: {list((theirs - mine).items())[:2]}",
    }
