"""Compare a Spark result with a DuckDB result, column by column name, regardless of row order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return repr(v)
    return str(v)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(_cell(r[i]) for i in order) for r in rows])


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    result = con.execute(sql)
    want_columns, want = _canonical([d[0] for d in result.description], result.fetchall())
    have_columns, have = _canonical(df.columns, [tuple(r) for r in df.collect()])
    if want_columns != have_columns:
        return f"columns {have_columns} != {want_columns}"
    if len(want) != len(have):
        return f"{len(have)} rows != {len(want)}"
    for h, w in zip(have, want):
        if h != w:
            return f"have {h}\n     want {w}"
    return None
