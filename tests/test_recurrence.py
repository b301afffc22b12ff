"""Due dates: worked examples and a walk over every day."""

from __future__ import annotations

import calendar
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.recurrence import next_due

SHAPE = "n int, frequency string, interval_n int, day int, start_date date, end_date date"
CASES = [
    ("Monthly", 1, 31, "2018-02-05", "2018-12-31", "2018-03-31"),
    ("Monthly", 2, 10, "2018-01-15", "2018-12-31", "2018-03-10"),
    ("Monthly", 1, 25, "2018-01-26", "2018-02-20", None),
    ("Monthly", 1, -1, "2018-02-05", "2020-12-31", "2018-02-28"),
    ("Weekly", 1, 25, "2018-01-01", "2018-12-31", "2018-01-25"),
    ("Weekly", 2, 25, "2018-01-15", "2018-12-31", "2018-04-25"),
    ("Weekly", 2, 25, "2018-01-08", "2018-12-31", "2018-01-25"),
    ("Yearly", 1, 10, "2018-03-15", "2020-12-31", "2018-04-10"),
    ("Yearly", 2, 10, "2018-12-15", "2021-12-31", "2020-01-10"),
    ("Yearly", 1, 0, "2018-03-15", "2020-12-31", "2018-03-15"),
    ("monthly", 1, None, "2018-03-15", "2020-12-31", "2018-03-15"),
    ("quarterly", 1, 14, "2018-03-15", "2020-12-31", "2018-06-14"),
    ("Daily", 1, 14, "2018-03-15", "2020-12-31", None),
    ("Monthly", 1, 10, "2018-03-15", "2018-03-01", None),
    ("Monthly", 0, 10, "2018-03-15", "2019-03-01", None),
    ("Monthly", 1, 32, "2018-03-15", "2019-03-01", None),
    ("Monthly", 12, 29, "1897-02-01", "2100-12-31", "1904-02-29"),
    ("Monthly", 24, 29, "2001-02-01", "2100-12-31", None),
    ("Monthly", 12, 31, "2001-02-01", "2100-12-31", None),
    ("Monthly", 1, 5, "2018-03-15", None, "2018-04-05"),
    ("Monthly", 2_000_000_000, 5, "2018-03-15", None, None),
    ("Yearly", 2_000_000_000, 5, "2018-03-15", None, "2018-04-05"),
    ("Yearly", 240, 10, "1850-12-15", None, "2090-01-10"),
    ("Monthly", 2880, 10, "1850-12-15", None, "2090-12-10"),
    ("Quarterly", 960, 10, "1850-12-15", None, "2090-12-10"),
    ("Quarterly", 2_000_000_000, 10, "1850-12-15", None, None),
    ("Monthly", 2412, 10, "1850-12-15", None, "2051-12-10"),
    ("Weekly", 2_000_000_000, 5, "2018-03-15", None, None),
]


def due(spark, rules):
    day = lambda t: dt.date.fromisoformat(t) if isinstance(t, str) else t
    rows = spark.createDataFrame(
        [(i, f, n, d, day(s), day(e)) for i, (f, n, d, s, e) in enumerate(rules)], SHAPE)
    found = rows.select("n", next_due(*[F.col(c) for c in SHAPE.replace(",", "").split()[2::2]]).alias("due"))
    return [r.due for r in found.orderBy("n").collect()]


def test_examples(spark):
    expected = [c[5] and dt.date.fromisoformat(c[5]) for c in CASES]
    assert due(spark, [c[:5] for c in CASES]) == expected


def walk(frequency, interval, day, start, end):
    """The first fitting date, trying every day."""
    monday = start - dt.timedelta(days=start.weekday())
    at = start
    while at <= end:
        length = calendar.monthrange(at.year, at.month)[1]
        months = (at.year - start.year) * 12 + at.month - start.month
        fits = {
            "Monthly": months % interval == 0, "Quarterly": months % (3 * interval) == 0,
            "Yearly": (at.year - start.year) % interval == 0,
            "Weekly": (at - monday).days // 7 % interval == 0}[frequency]
        if fits and at.day == (day if day > 0 else length + 1 + day):
            return at
        at += dt.timedelta(days=1)
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_walk(spark, seed):
    rng = random.Random(seed)
    rules = []
    for _ in range(1500):
        start = dt.date(1990, 1, 1) + dt.timedelta(days=rng.randrange(9000))
        rules.append((
            rng.choice(["Monthly", "Quarterly", "Yearly", "Weekly"]), rng.choice([1, 2, 3, 4, 5, 7, 12, 24, 53]),
            rng.choice([*range(1, 32), 29, 30, 31, -1, -2, -28, -29, -30, -31]), start,
            start + dt.timedelta(days=rng.choice([10, 60, 400, 4000]))))
    assert due(spark, rules) == [walk(*r) for r in rules]
