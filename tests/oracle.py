"""Comparing a query with its SQL on a data folder."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

DATA = Path("/root/testdata/sf0.001")


def connection(folder: Path) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def _plain(value: object) -> object:
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return round(float(value), 5) + 0.0
    return str(value)


def rows_of(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, query: Callable[[SparkSession, str], DataFrame], sql: str, folder: Path = DATA) -> None:
    found = query(spark, str(folder))
    got = rows_of(found.columns, [tuple(r) for r in found.collect()])
    want = connection(folder).execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    want = rows_of(names, want.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
