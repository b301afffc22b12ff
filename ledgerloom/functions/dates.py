"""Date columns."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dates outside this span are not accepted.
FIRST_DATE = dt.date(1900, 1, 1)
LAST_DATE = dt.date(2100, 12, 31)


def month_of(date: Column) -> Column:
    """First day of the month."""
    return F.trunc(date, "MM")


def month_label(month: Column) -> Column:
    return F.date_format(month, "yyyy-MM")


def months_back(last: Column, months: int) -> Column:
    """First day of the calendar month `months - 1` before the month of `last`."""
    return F.add_months(F.trunc(last, "MM"), 1 - months)


def row_order(date: Column, tid: Column, lowest_id_last: bool = False) -> Column:
    """Date and id as one number that grows with the date and, on one date, with
    the id (or against it). Unlike a struct it can be aggregated by hash."""
    day = F.datediff(date, F.lit(dt.date(1970, 1, 1))).cast("decimal(10,0)")
    place = tid.cast("decimal(19,0)")
    days = day * F.lit(Decimal(10) ** 19).cast("decimal(20,0)")
    return days - place if lowest_id_last else days + place


def accepted_date(date: Column, as_of: dt.date) -> Column:
    """The date if it lies in the accepted span, else the load date."""
    date = date.try_cast("date")
    return F.when(date.between(F.lit(FIRST_DATE), F.lit(LAST_DATE)), date).otherwise(F.lit(as_of))


def parse_day_first(text: str | None) -> dt.date | None:
    """A `dd/MM/yyyy` parameter; empty means none."""
    return dt.datetime.strptime(text, "%d/%m/%Y").date() if text else None
