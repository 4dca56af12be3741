"""Compare a query with its SQL in DuckDB, order aside."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return [_cell(y) for y in x]
    if x is None or x is pd.NA or x is pd.NaT or x != x:
        return None
    x = x.item() if hasattr(x, "item") else x
    if isinstance(x, float):
        return int(x) if x == int(x) else round(x, 6)
    if hasattr(x, "isoformat"):
        return str(x)[:10] if str(x).endswith("00:00:00") else str(x)
    return x


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr([_cell(x) for x in r]) for r in frame.itertuples(index=False))
