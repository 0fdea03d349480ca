"""Compare a query with its oracle in DuckDB over the same Parquet tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if pd.isna(x):
            return None
        return float(x) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    cols = sorted(df.columns)
    return sorted((tuple(plain(x) for x in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    g, w = rows(got), rows(want)
    if len(g) != len(w):
        return f"{len(g)} rows against {len(w)}"
    wrong = [(a, b) for a, b in zip(g, w, strict=True) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None
