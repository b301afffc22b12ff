"""Column rules applied when rows are written: every value ends up valid."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import FIRST_DATE, LAST_DATE, accepted_date
from ledgerloom.functions.money import parse_money
from ledgerloom.functions.text import bounded
from ledgerloom.schema import MONEY

# Text lengths and what replaces a value that is not accepted.
NAME_LENGTH, TAG_LENGTH = 128, 64
DEFAULT_FREQUENCY, DEFAULT_INTERVAL, DEFAULT_DAY, DEFAULT_TAG = "monthly", 1, 16, "Todo"
DEFAULT_BUDGET = 123


def _amount(name: str = "amount", default: int = 0) -> Column:
    return F.coalesce(parse_money(F.col(name)), F.lit(default).cast(MONEY))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _texts(*names: str) -> dict[str, Column]:
    return {n: bounded(F.col(n), NAME_LENGTH) for n in names}


def normalise_transactions(rows: DataFrame, as_of: dt.date) -> DataFrame:
    return rows.withColumns({
        "date": accepted_date(F.col("date"), as_of),
        "amount": _amount(),
        **_texts("type", "description", "category", "subcategory", "payee"),
        "tag": bounded(F.col("tag"), TAG_LENGTH),
        "status": _flag("status"),
    })


def normalise_staging(rows: DataFrame, as_of: dt.date) -> DataFrame:
    return rows.withColumns({
        "date": accepted_date(F.col("date"), as_of),
        "amount": _amount(),
        **_texts("type"),
        "description": bounded(F.col("description"), NAME_LENGTH, ""),
        "beneficiary": bounded(F.col("beneficiary"), NAME_LENGTH, ""),
    })


def normalise_schedules(rows: DataFrame, as_of: dt.date) -> DataFrame:
    """Schedules approved outside the accepted dates are rejected."""
    approved = F.col("last_approved").try_cast("date")
    accepted = approved.between(F.lit(FIRST_DATE), F.lit(LAST_DATE)) | F.col("last_approved").isNull()
    return rows.where(F.coalesce(accepted, F.lit(False))).withColumns({
        "frequency": bounded(F.col("frequency"), NAME_LENGTH, DEFAULT_FREQUENCY),
        "interval_n": F.coalesce(F.col("interval_n").try_cast("int"), F.lit(DEFAULT_INTERVAL)),
        "day": F.coalesce(F.col("day").try_cast("int"), F.lit(DEFAULT_DAY)),
        "start_date": accepted_date(F.col("start_date"), as_of),
        "end_date": accepted_date(F.col("end_date"), as_of),
        "active": _flag("active"),
        "last_approved": approved,
        "amount": _amount(),
        **_texts("type", "description", "category", "subcategory", "payee"),
        "tag": bounded(F.col("tag"), TAG_LENGTH, DEFAULT_TAG),
    })


def normalise_budgets(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        **_texts("subject", "unit"),
        "limit_amount": _amount("limit_amount", DEFAULT_BUDGET),
        "last_month": _amount("last_month"),
        "avg_month": F.coalesce(F.col("avg_month").cast("string").try_cast("decimal(18,6)"),
                                F.lit(0).cast("decimal(18,6)")),
        "apply": _flag("apply"),
    })
