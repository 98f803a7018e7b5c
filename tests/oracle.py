"""Compare a query with its DuckDB SQL on one scale's tables."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql):
    """None if equal, else a short account."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, got = rows_of(names, cur.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want == got:
        return None
    a, b = set(map(str, got)), set(map(str, want))
    return f"rows {len(got)} and {len(want)}; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
