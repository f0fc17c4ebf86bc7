"""Sessions and comparisons for the tests."""

from __future__ import annotations

import datetime as dt
import decimal
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(value, x))
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


def oracle(sql: str, sf_dir: str = DATA) -> tuple[list[str], Counter]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    return sorted(columns), rows_of(columns, found.fetchall())


def difference(spark, name: str, query, sql: str, sf_dir: str = DATA) -> str:
    """Empty if query and SQL agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    columns, want = oracle(sql, sf_dir)
    if sorted(df.columns) != columns:
        return f"{name}: columns {sorted(df.columns)} and {columns}"
    if got != want:
        return f"{name}: {sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return ""
