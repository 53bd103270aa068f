"""Row-for-row comparison of a registered query with its SQL, as multisets."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return datetime.datetime(value.year, value.month, value.day)
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(df, sql: str, con) -> str | None:
    """None if both sides agree in names, kinds of value and rows, else a short report."""
    result = con.execute(sql)
    want_cols, want = normal([c[0] for c in result.description], result.fetchall())
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != got_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(want) != len(got):
        return f"{len(got)} rows, SQL has {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference: spark {a} sql {b}"
    for i, name in enumerate(want_cols):
        kinds = [{type(r[i]) for r in side if r[i] is not None} for side in (got, want)]
        if kinds[0] != kinds[1]:
            return f"{name} has types {kinds[0]} and {kinds[1]}"
    return None
