"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{type(value).__name__}:{value!r}"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> list[str]:
    """Human-readable differences; empty when columns, types and values agree."""
    result = con.execute(sql)
    names, expected = [c[0] for c in result.description], result.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    got, want = _rows(df.columns, df.collect()), _rows(names, expected)
    out = [f"rows {len(got)} != {len(want)}"] if len(got) != len(want) else []
    return out + [f"{g} != {w}" for g, w in zip(got, want) if g != w][:5]
