"""Rows of a query and of its SQL, comparable."""

from __future__ import annotations

import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5)
    return str(v)


def both(spark, entry, name, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = entry.queries()[name](spark, sf_dir)
    mine = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    theirs = [tuple(plain(r[k]) for k in order) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return sorted(df.columns), sorted(cols), sorted(mine, key=key), sorted(theirs, key=key)
