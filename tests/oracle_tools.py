"""Run a registered query and its SQL twin and compare them without regard to row order."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str, show: int = 4) -> str | None:
    """None when both agree, else a short description."""
    got = spark_df.collect()
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    want = expected.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} / {sorted(names)}"
    a, b = sorted_rows(spark_df.columns, got), sorted_rows(names, want)
    if a == b:
        return None
    only_a, only_b = set(map(repr, a)) - set(map(repr, b)), set(map(repr, b)) - set(map(repr, a))
    return (
        f"rows {len(a)} / {len(b)}; {len(only_a)} only in Spark, {len(only_b)} only in SQL\n"
        f"  spark: {sorted(only_a)[:show]}\n  sql:   {sorted(only_b)[:show]}"
    )
