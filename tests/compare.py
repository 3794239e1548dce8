"""Rows of a Spark query against a DuckDB query over the same files."""

from pathlib import Path

import duckdb
import pandas as pd


def plain(df, columns):
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    rows = [tuple(text(v.item() if hasattr(v, "item") else v) for v in r) for r in df[columns].itertuples(index=False)]
    return sorted(rows)


def assert_same(spark, run, sql, folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = run(spark, str(folder)).toPandas(), con.sql(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert plain(got, columns) == plain(want, columns)
