"""Spark-vs-DuckDB result comparison used by the tests and scripts/parity.py.

Columns are compared by name (sorted), rows as an order-insensitive multiset
after normalising numbers (rounded), dates and times.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

from ..sources.driver import DRIVER_TABLES


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return round(f, 6)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return str(v)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: spark={sorted(spark_cols)} duck={sorted(duck_cols)}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = Counter(tuple(norm(r[i]) for i in si) for r in spark_rows)
    b = Counter(tuple(norm(r[i]) for i in di) for r in duck_rows)
    if a == b:
        return None
    only_a = list((a - b).elements())[:3]
    only_b = list((b - a).elements())[:3]
    return f"rows differ (spark {len(spark_rows)} vs duck {len(duck_rows)}); spark-only {only_a}; duck-only {only_b}"


