"""Run a query on Spark and its SQL on DuckDB, and compare the results as sets of rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

SOURCES = ("region nation customer supplier part orders lineitem events documents embeddings "
           "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in SOURCES:
        path = Path(folder) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(r[i]).__name__, r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None if equal, otherwise what differs."""
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = _rows(columns, result.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if expected != actual:
        return (f"{sum(actual.values())} rows vs {sum(expected.values())}; only here "
                f"{list((actual - expected).items())[:2]}; only there "
                f"{list((expected - actual).items())[:2]}")
    return None
