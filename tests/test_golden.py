"""The generated account, with values worked out by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from ledgerloom.operators import balances, budgets, filters, shares

MONTHS = [f"2018-{m:02d}" for m in range(1, 13)]
NET = [-230, -130, -290, -330, -570, -430, -470, -510, -550, -590, -630, -670]
CLOSING = [1770, 1640, 1350, 1020, 450, 20, -450, -960, -1510, -2100, -2730, -3400]


@pytest.fixture
def account(spark):
    return spark.createDataFrame(
        [(1, "a", 7, "u", "EUR", Decimal(2000)), (2, "b", 8, "u", "EUR", Decimal(5))],
        "account_id long, name string, number int, holder string, currency string, balance decimal(18,2)")


def test_overview(account, generated):
    rows = {r.account_id: r for r in balances.account_overview(account, generated).collect()}
    assert (rows[1].total_transactions, rows[1].pending_transactions) == (24, 0)
    assert rows[1].closing_balance == -3400
    assert (rows[2].total_transactions, rows[2].closing_balance) == (0, 5)
    total = balances.portfolio_total(account, generated).first()
    assert (total.closing_total, total.ledger_total) == (-3395, -5400)


def test_overview_without_any_rows(account, ledger):
    empty = ledger({}).limit(0)
    assert [r.closing_balance for r in balances.account_overview(account, empty).orderBy("account_id").collect()] == [2000, 5]
    assert balances.portfolio_total(account, empty).first().ledger_total == 0


def test_year_pivot(generated):
    wide = shares.pivot(shares.spend_by_period(generated, "category", "year")).first()
    assert (wide.period, wide.Household) == (2018, -5400)


def test_months(generated, openings):
    net = shares.spend_by_period(generated, "category").orderBy("period").collect()
    assert [(r.period, r.net) for r in net] == list(zip(MONTHS, NET))
    for closing in (balances.closing_by_month, balances.closing_by_month_outgo):
        rows = closing(generated, openings(a1="2000")).orderBy("yearmonth").collect()
        assert [(r.yearmonth, r.closing_balance) for r in rows] == list(zip(MONTHS, CLOSING))


def test_trailing(generated):
    rows = filters.trailing_months(generated, 3).orderBy("date").collect()
    assert [r.amount for r in rows] == [-290, -300, -310, -320, -330, -340]


def test_subjects(generated):
    assert budgets.last_month(generated, "category").first().last_month == -670
    assert budgets.average_month(generated, "category").first().avg_month == -450
    assert shares.spend_share(shares.spend_by_period(generated, "category")).first().spent == 5400
    percent = shares.percent_of_income(shares.spend_by_period(generated, "category")).collect()
    assert {r.percent for r in percent} == {0.0}


def test_no_income_makes_every_gauge_zero(spark, account, generated):
    assert budgets.average_monthly_income(generated).first().average_income is None
    none = spark.createDataFrame([], "account_id long, subject string, limit_amount decimal(18,2), apply boolean")
    rows = {r.account_id: r for r in budgets.budget_gauge(
        account, generated, none, none, dt.date(2018, 12, 30)).collect()}
    assert (rows[1].period, rows[1].category, rows[1].tag) == ("2018-12", "Household", "Routine")
    assert (rows[2].period, rows[2].category) == (None, "")
    for r in rows.values():
        assert {r.expense_spent_pct, r.tag_pct, r.category_pct, r.subcategory_pct} == {0.0}


def test_ledger_log(generated, openings):
    log = balances.ledger_log(generated, openings(a1="2000")).orderBy("date").collect()
    assert (log[-1].closing_balance, log[0].closing_balance) == (1660, -3400)


def test_gauge(spark, account, ledger):
    rows = ledger(
        {"date": dt.date(2001, 6, 3), "amount": 1000},
        {"date": dt.date(2001, 5, 3), "amount": 500, "tag": None},
        {"date": dt.date(2001, 5, 4), "amount": 9000, "tag": "Superfuture"},
        {"date": dt.date(2001, 7, 2), "amount": -100, "category": "x"},
        {"date": dt.date(2001, 7, 9), "amount": -60, "category": "y", "subcategory": "k"},
        {"date": dt.date(2001, 7, 9), "amount": 10, "category": "y", "subcategory": "z"},
        {"date": dt.date(2001, 8, 1), "amount": -1, "category": "later"})
    shape = "account_id long, subject string, limit_amount decimal(18,2), apply boolean"
    categories = spark.createDataFrame([(1, "y", Decimal(200), True)], shape)
    subcategories = spark.createDataFrame([(1, "k", Decimal(200), False)], shape)
    r = budgets.budget_gauge(account, rows, categories, subcategories, dt.date(2001, 7, 15)).where("account_id = 1").first()
    # Income: July 10, June 1000, May 500 (a null tag counts), so 1510 / 3.
    income = 1510 / 3
    assert (r.period, r.category, r.subcategory) == ("2001-07", "y", "k")
    assert r.expense_spent_pct == pytest.approx(160 * 100 / income)
    assert r.tag_pct == pytest.approx(150 * 100 / income)
    assert r.category_pct == 25.0
    assert r.subcategory_pct == pytest.approx(60 * 100 / income)
    later = budgets.budget_gauge(account, rows, categories, subcategories, dt.date(2009, 1, 1)).where("account_id = 1").first()
    assert (later.period, later.category, later.category_pct) == ("2001-08", "later", 0.0)


def test_percent_nets_each_subject_and_rounds_half_up(ledger):
    day = dt.date(2001, 3, 3)
    cells = shares.spend_by_period(ledger(
        {"date": day, "amount": 100, "tag": " job "}, {"date": day, "amount": 300, "tag": "job"},
        {"date": day, "amount": 50, "tag": "food"}, {"date": day, "amount": "-100.50", "tag": "food"},
        {"date": day, "amount": "-0.18", "tag": "gum"}, {"date": day, "amount": -9, "tag": "not provided"},
        {"date": day, "amount": -9, "tag": None}), "tag", "year")
    rows = {r.subject: (r.income, r.percent) for r in shares.percent_of_income(cells).collect()}
    # 50.50 / 400 is 12.625 %, 0.18 / 400 is 0.045 %.
    assert rows == {"job": (400, 0.0), "food": (400, 12.63), "gum": (400, 0.05)}


def test_outgo_balances_stop_at_the_last_outgo(ledger, openings):
    rows = ledger(
        {"date": dt.date(2001, 1, 1), "amount": -10}, {"date": dt.date(2001, 1, 2), "amount": 100},
        {"date": dt.date(2001, 2, 1), "amount": 5}, {"date": dt.date(2001, 3, 1), "amount": -1})
    closing = balances.closing_by_month_outgo(rows, openings(a1="0")).orderBy("yearmonth").collect()
    assert [(r.yearmonth, r.closing_balance) for r in closing] == [("2001-01", -10), ("2001-03", 94)]
    closing = balances.closing_by_month(rows, openings(a1="0"), 2).orderBy("yearmonth").collect()
    assert [(r.yearmonth, r.closing_balance) for r in closing] == [("2001-02", 95), ("2001-03", 94)]


def test_latest_rows(ledger):
    day = dt.date
    rows = ledger(
        {"account_id": 1, "date": day(2001, 6, 15)}, {"account_id": 1, "date": day(2001, 6, 16)},
        {"account_id": 1, "date": day(2002, 1, 1)},
        {"account_id": 2, "date": day(2001, 6, 15)}, {"account_id": 2, "date": day(2001, 6, 9)},
        {"account_id": 2, "date": day(2001, 6, 8)})
    kept = filters.latest_rows(rows, day(2001, 7, 15))
    assert sorted(r.tid for r in kept.collect()) == [1, 2, 3, 4]


def test_row_order(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions.dates import row_order

    pairs = [(dt.date(1899, 12, 31), 2**63 - 1), (dt.date(1900, 1, 1), 0), (dt.date(1970, 1, 1), 5),
             (dt.date(1970, 1, 1), 2**63 - 1), (dt.date(2100, 12, 31), 0)]
    rows = spark.createDataFrame(pairs[::-1], "date date, tid long")
    up = rows.orderBy(row_order(F.col("date"), F.col("tid"))).collect()
    assert [tuple(r) for r in up] == pairs
    down = rows.orderBy(row_order(F.col("date"), F.col("tid"), lowest_id_last=True)).collect()
    assert [tuple(r) for r in down] == [pairs[i] for i in (0, 1, 3, 2, 4)]
