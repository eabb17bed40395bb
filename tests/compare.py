"""Runs a query's oracle in DuckDB and compares rows, columns and values."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list | tuple):
        return tuple(_plain(y) for y in x)
    if isinstance(x, int | float) or type(x).__name__ == "Decimal":
        return float(x)
    return str(x)


def difference(spark_df, con, sql: str) -> str | None:
    """None if the two agree, else what differs first."""
    found = con.sql(sql)
    names = sorted(spark_df.columns)
    if names != sorted(found.columns):
        return f"columns {names} and {sorted(found.columns)}"
    order = [found.columns.index(n) for n in names]
    key = lambda r: tuple((v is not None, str(type(v)), round(v, 3) if isinstance(v, float) else v) for v in r)
    ours = sorted((tuple(_plain(r[n]) for n in names) for r in spark_df.collect()), key=key)
    theirs = sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=key)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            if x != y and not (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)):
                return f"{dict(zip(names, a, strict=True))} and {dict(zip(names, b, strict=True))}"
    return None
