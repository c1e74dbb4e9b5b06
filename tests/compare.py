"""Side by side: a Spark query and its DuckDB twin."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    flat = lambda v: tuple(v) if isinstance(v, list) else ("nan" if isinstance(v, float) and math.isnan(v) else v)
    return sorted((tuple(flat(r[k]) for k in order) for r in values), key=repr)


def differences(spark, sf: str, query, sql: str) -> str:
    """Empty if both give the same rows under the same column names."""
    df = query(spark, sf)
    got = duck(sf).execute(sql)
    names = [c[0] for c in got.description]
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, got.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(a)} and {len(b)} rows, {len(bad)} differ: {bad[:3]}"
    return ""
