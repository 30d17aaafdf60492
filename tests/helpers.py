"""Comparing results with DuckDB and with sets of rows."""

from __future__ import annotations

import os
from pathlib import Path

import pandas as pd

DATA = Path(os.environ.get("TEST_DATA_DIR", "/root/testdata/sf0.001"))


def rows(df) -> set:
    return {tuple(r) for r in df.collect()}


def duck(directory: Path):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in sorted(directory.iterdir()):
        if f.suffix == ".parquet":
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return c


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return ""
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.9g}"
        return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(one(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))
