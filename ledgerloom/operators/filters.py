"""Row filters of the ledger."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import FIRST_DATE, LAST_DATE, months_back
from ledgerloom.plans.skew import lookup_join


def completed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status"))


def still_open(rows: DataFrame) -> DataFrame:
    """Not completed; an unknown status is neither."""
    return rows.where(~F.col("status"))


def with_nature(rows: DataFrame) -> DataFrame:
    """`nature`: income above zero, else outgo."""
    return rows.withColumn("nature", F.when(F.col("amount") > 0, "income").otherwise("outgo"))


def outgo(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce(F.col("amount") > 0, F.lit(False)))


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class LedgerFilter:
    """Typed parameters of the ledger filter; None means not given."""

    date_from: dt.date | None = None
    date_to: dt.date | None = None
    amount_ge: Decimal | None = None
    amount_le: Decimal | None = None
    category_like: str | None = None
    tag_like: str | None = None
    description_like: str | None = None


def _range(name: str, low, high) -> list[Column]:
    """Inclusive bounds; none at all when both are given and not in order."""
    if low is not None and high is not None and not low < high:
        return []
    bounds = []
    if low is not None:
        bounds.append(F.col(name) >= F.lit(low))
    if high is not None:
        bounds.append(F.col(name) <= F.lit(high))
    return bounds


def ledger_filter(rows: DataFrame, f: LedgerFilter) -> DataFrame:
    """Ranges of date and amount, and case-sensitive regex matches."""
    conditions = _range("date", f.date_from, f.date_to) + _range("amount", f.amount_ge, f.amount_le)
    for name, pattern in [("category", f.category_like), ("tag", f.tag_like),
                          ("description", f.description_like)]:
        if pattern:
            conditions.append(F.col(name).rlike(pattern))
    return rows.where(_all(conditions))


def clamped_filter(
    rows: DataFrame,
    as_of: dt.date,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    amount_ge: Decimal | None = None,
    amount_le: Decimal | None = None,
    moves: DataFrame | None = None,
) -> DataFrame:
    """Ranges whose missing ends are the account's own least and greatest values,
    and which widen to those when the ends are not in order.

    A range with no end, or with its ends in the wrong order, keeps every row that
    has a value. Only a range with one end needs the account's extremes; `moves` may
    give the rows' account_id, date and amount alone.
    """

    def accepted(d: dt.date | None) -> dt.date | None:
        return d if d is None or FIRST_DATE <= d <= LAST_DATE else as_of

    ranges = {"date": (accepted(date_from), accepted(date_to)), "amount": (amount_ge, amount_le)}
    columns = rows.columns
    one_sided = [n for n, (low, high) in ranges.items() if (low is None) != (high is None)]
    if one_sided:
        extremes = [f(n).alias(f"{f.__name__}_{n}") for n in one_sided for f in (F.min, F.max)]
        bounds = (rows if moves is None else moves).groupBy("account_id").agg(F.count(F.lit(1)).alias("n_rows"), *extremes)
        rows = lookup_join(rows, bounds.drop("n_rows"), ["account_id"], ["tid"], "inner", counts=bounds, nulls_match=True)
    conditions = []
    for name, (low, high) in ranges.items():
        col = F.col(name)
        conditions.append(col.isNotNull())
        if low is None and high is None:
            continue
        if low is not None and high is not None:
            conditions += _range(name, low, high)
            continue
        low_col = F.col(f"min_{name}") if low is None else F.lit(low)
        high_col = F.col(f"max_{name}") if high is None else F.lit(high)
        conditions.append((low_col >= high_col) | col.between(low_col, high_col))
    return rows.where(_all(conditions)).select(*columns)


@dataclass(frozen=True)
class TableFilter:
    """Filters of the table view, all joined by AND; None means not set."""

    amount_above: Decimal | None = None
    amount_below: Decimal | None = None
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    type: str | None = None
    category: str | None = None
    payee: str | None = None
    description: str | None = None
    tags: str | None = None
    status: bool | None = None


def table_filter(rows: DataFrame, f: TableFilter) -> DataFrame:
    conditions = []
    if f.amount_above is not None:
        conditions.append(F.col("amount") > F.lit(f.amount_above))
    if f.amount_below is not None:
        conditions.append(F.col("amount") < F.lit(f.amount_below))
    if f.date_from is not None:
        conditions.append(F.col("date") >= F.lit(f.date_from))
    if f.date_to is not None:
        conditions.append(F.col("date") <= F.lit(f.date_to))
    if f.type is not None:
        conditions.append(F.col("type") == f.type)
    for name in ("category", "payee", "description"):
        text = getattr(f, name)
        if text is not None:
            conditions.append(F.contains(F.lower(name), F.lit(text.lower())))
    if f.tags is not None:
        conditions.append(F.col("tag").isin(f.tags.split(", ")))
    if f.status is not None:
        conditions.append(F.col("status") == f.status)
    return rows.where(_all(conditions))


def filtered_totals(rows: DataFrame, f: TableFilter) -> DataFrame:
    """Number of rows kept and the sum of their amounts, to 2 decimals."""
    return table_filter(rows, f).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(28,2)").alias("total"))


def trailing_months(rows: DataFrame, months: int) -> DataFrame:
    """Rows in the month of the account's last row and the `months - 1` before. Rows without
    an account are a group like any other."""
    last = rows.groupBy("account_id").agg(
        F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_rows"))
    kept = lookup_join(rows, last.drop("n_rows"), ["account_id"], ["tid"], "inner", counts=last, nulls_match=True)
    return kept.where(F.col("date") >= months_back(F.col("last_date"), months)).select(*rows.columns)


def latest_rows(rows: DataFrame, as_of: dt.date, moves: DataFrame | None = None) -> DataFrame:
    """Newest first, rows of the last 30 days; for an account without any, those of the 7 days
    before its last row. Future rows belong to the first kind. `moves` may give the
    rows' account_id and date alone."""
    last = (rows if moves is None else moves).groupBy("account_id").agg(
        F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_rows"))
    near = F.date_sub(F.lit(as_of), 30)
    since = F.when(F.col("last_date") > near, near).otherwise(F.date_sub("last_date", 7))
    kept = lookup_join(rows, last.drop("n_rows"), ["account_id"], ["tid"], "inner", counts=last, nulls_match=True)
    newest = [F.col("date").desc(), F.col("tid").desc()]
    return kept.where(F.col("date") > since).select(*rows.columns).orderBy(*newest)


def trailing_cells(cells: DataFrame, months: int) -> DataFrame:
    """`trailing_months` for sums already keyed by account and `month`; adds the account's `last_month`.

    The last month of each account is one aggregate, joined to the sums by account. The sums are few next to the rows, so there is no list of hot
    accounts: an account with very many subjects is split by the adaptive skew join. No task needs all sums of an account.
    """
    last = (cells.groupBy("account_id").agg(F.max("month").alias("last_month")).where("last_month is not null")
            .select(F.col("account_id").alias("__account"), "last_month"))
    recent = F.col("month") >= months_back(F.col("last_month"), months)
    return cells.join(last, F.col("account_id").eqNullSafe(F.col("__account"))).where(recent).drop("__account")
