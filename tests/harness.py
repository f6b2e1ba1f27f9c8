"""Runs a registered query and its oracle on one scale and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

# Significant digits compared; STRICT compares doubles as they are.
DIGITS = 17 if os.environ.get("STRICT") else 9

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.{DIGITS}g}")
    if isinstance(v, int):
        return float(f"{float(v):.15g}")
    return str(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shaped = [tuple(_cell(r[i]) for i in order) for r in records]
    return sorted(columns), sorted(shaped, key=repr)


def compare(spark_df, con, sql):
    """None when equal, else what differs."""
    ours = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}; first ours {ours[1][:2]} theirs {theirs[1][:2]}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b:
            return f"{ours[0]}: ours {a} theirs {b}"
    return None
