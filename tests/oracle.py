"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

ROOT = os.environ.get("TESTDATA_ROOT", "/root/testdata")


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, repr(value + 0.0))
    if isinstance(value, bool):
        return (2, str(value))
    if isinstance(value, int):
        return (3, str(value))
    return (4, str(value))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(spark, con, build, text, folder) -> str | None:
    """None when both sides agree."""
    df = build(spark, folder)
    ours = _rows(df.columns, df.collect())
    result = con.execute(text)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    for left, right in zip(ours, theirs):
        if left != right:
            return f"{left} against {right}"
    return None if ours else "no rows"
