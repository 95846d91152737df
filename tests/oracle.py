"""Run registered queries in Spark and DuckDB and compare the row bags."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a short account of the difference."""
    df = query(spark, sf_dir)
    got_cols, got = bag(df.columns, df.collect())
    cur = con.execute(sql)
    want_cols, want = bag([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if not want:
        return "no rows"
    if got != want:
        extra, lack = got - want, want - got
        return (f"{sum(extra.values())} extra, {sum(lack.values())} lacking of "
                f"{sum(want.values())}; {list(extra)[:2]} vs {list(lack)[:2]}")
    return None
