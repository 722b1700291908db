"""A query and its SQL side by side, as the driver compares them."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def differences(df, con, sql: str) -> str:
    """Empty if both agree."""
    got = con.sql(sql)
    mine, theirs = rows(df.columns, df.collect()), rows(got.columns, got.fetchall())
    if sorted(df.columns) != sorted(got.columns):
        return f"columns {sorted(df.columns)} and {sorted(got.columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows; {mine[:2]} {theirs[:2]}"
    other = [(a, b) for a, b in zip(mine, theirs, strict=True) if a != b]
    return f"{len(other)} rows differ: {other[:2]}" if other else ""
