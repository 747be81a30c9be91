"""Comparison of a Spark query with its SQL in DuckDB: names, rows, values."""

import duckdb
import pandas as pd

from brindle.sources.tables import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (not isinstance(value, (list, tuple, dict)) and not hasattr(value, "shape") and pd.isna(value)):
        return "NULL"
    # A column of integers with nulls is one of floats in pandas, of nullable integers in DuckDB's frames.
    return str(int(value)) if isinstance(value, float) and value.is_integer() else repr(float(value)) if isinstance(value, float) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(_cell, r)) for r in frame.itertuples(index=False))


def assert_same(found, expected):
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)
