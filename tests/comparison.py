"""Runs a query and its SQL twin and compares columns, types and rows."""

from __future__ import annotations

import datetime as dt
import decimal
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return db


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(frame, db, sql: str) -> list[str]:
    """What differs; empty if both answers are the same bag of rows. An answer
    without rows would prove nothing and counts as a difference."""
    answer = db.execute(sql)
    names = [d[0] for d in answer.description]
    expected = _bag(names, answer.fetchall())
    found = _bag(frame.columns, [tuple(r) for r in frame.collect()])
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} instead of {sorted(names)}"]
    types = {type(v).__name__ for r in [*found, *expected] for v in r}
    notes = [f"decimals left in {types}"] if "tuple" in types else []
    if not expected:
        notes.append("no rows")
    missing, extra = expected - found, found - expected
    if missing or extra:
        notes.append(f"{sum(missing.values())} rows missing, {sum(extra.values())} extra of "
                     f"{sum(expected.values())}: {list(missing)[:2]} / {list(extra)[:2]} for {sorted(names)}")
    return notes
