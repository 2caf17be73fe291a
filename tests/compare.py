"""Compare a query with its SQL on one data folder."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings mem_records doc_records guards incoming search_queries container_sizes mix_targets".split()


def connect(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{root}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(row[k]) for k in order) for row in rows), key=repr)


def difference(spark, root: str, query, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    df = query(spark, root)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = connect(root)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows_of(names, got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        return f"{len(mine)} and {len(theirs)} rows; only here {sorted(a - b)[:3]}; only in SQL {sorted(b - a)[:3]}"
    return None
