"""Rows of a Spark query against rows of DuckDB."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    found = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return found


def rows_of(frame):
    columns = sorted(frame.columns)
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else float(v) if isinstance(v, float) else v
    rows = [tuple(plain(v) for v in r) for r in frame[columns].astype(object).values.tolist()]
    return columns, sorted(rows, key=lambda r: tuple((v is None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r))


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def assert_equal(spark_frame, duck_frame):
    (columns, mine), (other_columns, other) = rows_of(spark_frame), rows_of(duck_frame)
    assert columns == other_columns
    assert len(mine) == len(other)
    for a, b in zip(mine, other):
        assert all(map(same, a, b)), (a, b)
