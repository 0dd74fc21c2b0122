"""Compare a registered query with its DuckDB text, as multisets of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

from paceline.plans.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _value(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, bool) or value is None:
        return value
    return float(value) if isinstance(value, int) else value


def _normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def compare(frame, connection, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = connection.execute(sql)
    wanted_columns = [column[0] for column in cursor.description]
    wanted = cursor.fetchall()
    got = [tuple(row) for row in frame.collect()]
    if sorted(frame.columns) != sorted(wanted_columns):
        return f"columns {sorted(frame.columns)} against {sorted(wanted_columns)}"
    if not wanted:
        return "the oracle has no rows"
    if len(got) != len(wanted):
        return f"{len(got)} rows against {len(wanted)}"
    left, right = _normal(got, frame.columns), _normal(wanted, wanted_columns)
    if left != right:
        return f"only here {str(list((left - right).items())[:3])[:600]}\nonly there {str(list((right - left).items())[:3])[:600]}"
    return None
