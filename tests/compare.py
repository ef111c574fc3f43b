"""Compare a query's rows with those of its SQL."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def rows_of(records, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in records)


def sql_rows(sql: str, sf_dir: str) -> tuple[Counter, list[str]]:
    with duckdb.connect() as con:
        for table in Path(sf_dir).glob("*.parquet"):
            con.execute(f"create view {table.stem} as select * from read_parquet('{table}')")
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        return rows_of(found.fetchall(), columns), sorted(columns)


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs, empty when nothing does."""
    want, columns = sql_rows(sql, sf_dir)
    if sorted(df.columns) != columns:
        return [f"columns {sorted(df.columns)} and {columns}"]
    have = rows_of(df.collect(), df.columns)
    said = [f"only in Spark ({n}): {r}" for r, n in list((have - want).items())[:3]] + [f"only in SQL ({n}): {r}" for r, n in list((want - have).items())[:3]]
    return [f"{sum(have.values())} rows and {sum(want.values())}", *said] if said else []
