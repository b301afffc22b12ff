"""Next date of a recurring payment, as one row-local expression.

A rule is (frequency, interval, day of month, start, end). The answer is the
first date in [start, end] that falls on the day of the month, in a month
(monthly), a year (yearly) or a Monday-based week (weekly) that is a whole
number of intervals after that of the start. Days below zero count from the end
of the month; a month without the day is passed over.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.dates import LAST_DATE



def _day_in_month(month: Column, day: Column) -> Column:
    """The day in the month that starts at `month`; null if the month lacks it."""
    length = F.dayofmonth(F.last_day(month))
    return (
        F.when((day > 0) & (day <= length), F.date_add(month, day - 1))
        .when((day < 0) & (-day <= length), F.date_add(month, length + day))
    )


def _first_fit(months: Column, day: Column, start: Column, end: Column, fits=None) -> Column:
    dates = F.transform(months, lambda m: _day_in_month(m, day))

    def keep(c: Column) -> Column:
        inside = c.between(start, end)
        return inside if fits is None else inside & fits(c)

    return F.array_min(F.filter(dates, keep))


def _months(first: Column, last: Column, step: Column) -> Column:
    return F.sequence(first, last, F.make_ym_interval(F.lit(0), step))


def _monthly(step: Column, day: Column, start: Column, end: Column) -> Column:
    """Every `step` months.

    A step that is no multiple of 12 meets a month of 31 days within 12 steps, so
    13 candidates decide. Otherwise the month of the year never changes and only
    29 February can come late: then the whole span is tried, 202 months at most.
    """
    first, stop = F.trunc(start, "MM"), F.trunc(end, "MM")
    # A step past the end leaves the first month alone, as any longer one does.
    span = (F.year(stop) - F.year(first)) * 12 + F.month(stop) - F.month(first)
    step = F.least(step, span + 1).cast("int")
    stop = F.when(step % 12 == 0, stop).otherwise(F.least(stop, F.add_months(first, F.least(step, F.lit(4000)) * 12)))
    return _first_fit(_months(first, stop, step), day, start, end)


def _yearly(interval: Column, day: Column, start: Column, end: Column) -> Column:
    """Any month of every `interval`-th year: the rest of the first year, then
    January of the next eligible one, which has every day."""
    first = F.trunc(start, "MM")
    rest = F.sequence(
        first, F.make_date(F.year(start), F.lit(12), F.lit(1)),
        F.make_ym_interval(F.lit(0), F.lit(1)),
    )
    reached = interval <= F.year(end) - F.year(start)
    january = F.when(reached, F.make_date(F.year(start) + interval, F.lit(1), F.lit(1)))
    return _first_fit(F.concat(rest, F.array(january)), day, start, end)


def _weekly(interval: Column, day: Column, start: Column, end: Column) -> Column:
    """The day of the month inside every `interval`-th week. A near span is tried
    first, the whole one only where that finds nothing."""
    first = F.trunc(start, "MM")
    week = F.trunc(start, "WEEK")
    stop = F.trunc(end, "MM")

    def fits(c: Column) -> Column:
        weeks = F.floor(F.datediff(F.trunc(c, "WEEK"), week) / 7)
        return weeks % interval == 0

    def scan(last: Column) -> Column:
        return _first_fit(_months(first, last, F.lit(1)), day, start, end, fits)

    near = F.least(stop, F.add_months(first, F.least(interval, F.lit(100)) * 24))
    return F.coalesce(scan(near), scan(stop))


def next_due(frequency: Column, interval: Column, day: Column, start: Column, end: Column) -> Column:
    """The next date, or null if there is none or the frequency is unknown."""
    kind = F.lower(frequency)
    interval = interval.cast("int")
    day = F.coalesce(day.cast("int"), F.lit(0))
    end = F.least(F.coalesce(end, F.lit(LAST_DATE)), F.lit(LAST_DATE))
    known = kind.isin("yearly", "quarterly", "monthly", "weekly")
    return (
        F.when(start.isNull() | (start > end) | ~known | F.coalesce(interval < 1, F.lit(True)), None)
        .when(day == 0, start)
        .when(F.abs(day) > 31, None)
        .when(kind == "monthly", _monthly(interval, day, start, end))
        .when(kind == "quarterly", _monthly(interval.cast("long") * 3, day, start, end))
        .when(kind == "yearly", _yearly(interval, day, start, end))
        .when(kind == "weekly", _weekly(interval, day, start, end))
    )
