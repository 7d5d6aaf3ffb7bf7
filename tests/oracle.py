"""Compares a query's rows with those of its SQL in DuckDB."""

from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd


def connect(directory):
    con = duckdb.connect()
    for p in Path(directory).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(x):
    if x is None or x is pd.NaT or (not hasattr(x, "__len__") and pd.isna(x)):
        return None
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else str(round(x, 6))
    return str(x)


def rows(frame):
    return Counter(tuple(_plain(v) for v in r) for r in frame.astype(object).itertuples(index=False))


def agree(df, con, sql):
    columns = sorted(df.columns)
    theirs = con.execute(sql).df()
    assert sorted(theirs.columns) == columns
    ours, theirs = rows(df.select(columns).toPandas()), rows(theirs[columns])
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
