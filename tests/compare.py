"""Results as sorted tuples of text, so that Spark and DuckDB compare whatever the order of rows and columns."""

import os

import duckdb
import numpy as np
import pandas as pd


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, (list, np.ndarray)):
            return str([cell(x) for x in v])
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con
