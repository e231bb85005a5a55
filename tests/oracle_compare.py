"""Compare a Spark report with its DuckDB twin: columns by name, rows as a
multiset, values exactly (after mapping both engines' Python types onto
one canonical form)."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

RAW_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck_connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return canon(v.item())
    return v


def rows_of(cols: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    names = [cols[i] for i in order]
    return names, Counter(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark_df, sql: str, con: duckdb.DuckDBPyConnection) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    sn, sc = rows_of(s_cols, s_rows)
    dn, dc = rows_of(d_cols, d_rows)
    if sn != dn:
        return False, f"columns differ: spark={sn} duckdb={dn}"
    if sum(sc.values()) != sum(dc.values()):
        return False, f"row counts differ: spark={sum(sc.values())} duckdb={sum(dc.values())}"
    if sc != dc:
        only_s = list((sc - dc).elements())[:3]
        only_d = list((dc - sc).elements())[:3]
        return False, f"values differ ({len(list((sc - dc).elements()))} rows): spark-only={only_s} duckdb-only={only_d}"
    return True, f"{sum(sc.values())} rows"
