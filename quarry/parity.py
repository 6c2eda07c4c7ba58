"""Differential harness: every query against its SQL in DuckDB on the same Parquet files."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class Outcome:
    name: str
    same: bool
    rows: int
    expected: int
    note: str = ""


def duck(folder: str):
    """A DuckDB connection with a view per ``*.parquet`` of ``folder`` (file or directory)."""
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        source = path + "/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM read_parquet('{source}')")
    return con


def signature(value: object, digits: int = 9) -> object:
    """A comparable form: floats rounded relative to their size, dates and decimals as plain values."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (decimal.Decimal, float)):
        number = float(value)
        return number if not math.isfinite(number) else float(f"{number:.{digits}g}") + 0.0
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(signature(x, digits) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, signature(x, digits)) for k, x in value.items()))
    return value


def compare(name: str, df: DataFrame, con, sql: str) -> Outcome:
    """Row multisets, columns matched by name."""
    columns = sorted(df.columns)
    got = Counter(tuple(signature(v) for v in row) for row in df.select(*columns).collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return Outcome(name, False, sum(got.values()), -1, f"columns {columns} against {sorted(names)}")
    order = [names.index(c) for c in columns]
    want = Counter(tuple(signature(row[i]) for i in order) for row in cursor.fetchall())
    if got == want:
        return Outcome(name, True, sum(got.values()), sum(want.values()))
    extra, lacking = list((got - want).items())[:3], list((want - got).items())[:3]
    return Outcome(name, False, sum(got.values()), sum(want.values()), f"only here {extra}; only there {lacking}")
