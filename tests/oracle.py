"""Runs a query's SQL on another engine and compares the rows."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(sql: str, sf_dir: str) -> pd.DataFrame:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db.sql(sql).df()


def canonical(frame: pd.DataFrame) -> list:
    def cell(v):
        if isinstance(v, (list, tuple)):
            return str(v)
        if pd.isna(v):
            return ""
        if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, float) and not v.is_integer():
            return f"{v:.9g}"
        return str(int(v)) if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float", "uint")) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


def same(ours: pd.DataFrame, theirs: pd.DataFrame) -> None:
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)
