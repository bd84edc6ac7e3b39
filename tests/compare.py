"""Side-by-side comparison of a Spark result and DuckDB SQL."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True, na_position="first")


def differences(got: pd.DataFrame, want: pd.DataFrame) -> list[str]:
    """Human-readable differences; empty when both hold the same rows."""
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    got, want = ordered(got), ordered(want)
    out = []
    for c in got.columns:
        if str(got[c].dtype) != str(want[c].dtype):
            out.append(f"{c}: type {got[c].dtype} != {want[c].dtype}")
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if not same.all():
            i = same[~same].index[0]
            out.append(f"{c}: {(~same).sum()} differ, first {got[c][i]!r} != {want[c][i]!r}")
    return out
