"""Compare a registered query with its SQL twin on the same parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    return repr(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(frame, sql: str, con: duckdb.DuckDBPyConnection) -> list[str]:
    got_columns, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    relation = con.sql(sql)
    want_columns, want = rows_of(relation.columns, relation.fetchall())
    found = []
    if got_columns != want_columns:
        found.append(f"columns {got_columns} != {want_columns}")
    if len(got) != len(want):
        found.append(f"{len(got)} rows != {len(want)}")
    found += [f"{g} != {w}" for g, w in zip(got, want) if g != w][:3]
    return found
