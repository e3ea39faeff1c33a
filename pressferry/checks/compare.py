"""Spark-vs-DuckDB comparison used by the tests (same idea as the driver's gate:
row count, column names, order-insensitive value hash)."""

from __future__ import annotations

import datetime as _dt
import hashlib
import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duckdb_conn(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def rows_signature(columns: list[str], rows: list[tuple]) -> tuple[int, list[str], str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    lines = sorted(repr(tuple(_norm(r[i]) for i in order)) for r in rows)
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return len(rows), cols, digest


def spark_signature(df):
    rows = [tuple(r) for r in df.collect()]
    return rows_signature(df.columns, rows)


def duck_signature(con, sql: str):
    rel = con.sql(sql)
    cols = rel.columns
    rows = rel.fetchall()
    return rows_signature(cols, rows)


def diff(spark_df, con, sql: str, limit: int = 5) -> str:
    """Human-readable first differences (for debugging a mismatch)."""
    s_rows = {repr(tuple(_norm(x) for x in r)) for r in spark_df.collect()}
    rel = con.sql(sql)
    d_rows = {repr(tuple(_norm(x) for x in r)) for r in rel.fetchall()}
    only_s = sorted(s_rows - d_rows)[:limit]
    only_d = sorted(d_rows - s_rows)[:limit]
    return f"spark cols={spark_df.columns}\nduck cols={rel.columns}\nonly spark: {only_s}\nonly duck: {only_d}"
