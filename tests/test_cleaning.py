"""Cleaning, the category rewrite, normalising and promoting."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import budgets, cleaning, dedup, edits, normalise, promote, schedules, taxonomy, validation
from ledgerloom.operators.lookups import dimension_lists
from ledgerloom.sources.dimensions import CATEGORIES, SUBCATEGORIES, TYPES, dimension

AS_OF = dt.date(2001, 7, 15)

REWRITES = [
    (("Wage & Salary", "Net Pay"), ("Salary", "Monthly Fixed")),
    (("Wage & Salary", "Other"), ("Salary", "Other")),
    (("Automobile", "Insurance"), ("Mobility", "Monthly Fixed")),
    (("Automobile", "Automobile"), ("Mobility", "Insurance")),
    (("Insurance", "Automobile"), ("Mobility", "Insurance")),
    (("Insurance", "Health"), ("Healthcare", "Insurance")),
    (("Insurance", "x"), ("Healthcare", "Insurance")),
    (("Health-care", "Health"), ("Healthcare", "Insurance")),
    (("Food", "not provided"), ("Leisure", "Dining Out")),
    (("Entertainment", "x"), ("Leisure", "x")),
    (("Baby", "Fees"), ("Household", "Membership")),
    (("Fees", "x"), ("Uncategorized", "x")),
    (("Not an Expense", None), ("Funds Transfer", None)),
    (("elsewhere", "Loan Interest"), ("elsewhere", "Interest")),
    (("Loan", "Student Loan Interest"), ("Loan", "Interest")),
    (("Investment Income", "Loan Interest"), ("Investment", "Interest")),
    (("Travel/Vacation", "Lodging"), ("Travel", "Hotel")),
    (("Utilities", "x"), ("Bills", "Utilities")),
    (("Bills", "Cell Phone"), ("Bills", "Telephone")),
    (("Other Income", "x"), ("Other Income", "Gifts")),
    ((None, "Automobile"), (None, "Automobile")),
    ((None, None), (None, None)),
    (("", ""), ("", "")),
    (("food", "x"), ("food", "x")),
]


def test_rewrites(spark):
    rows = spark.createDataFrame(
        [(i, *pair) for i, (pair, _) in enumerate(REWRITES)], "pos int, category string, subcategory string")
    found = taxonomy.reformat_taxonomy(rows).orderBy("pos").collect()
    assert [(r.category, r.subcategory) for r in found] == [to for _, to in REWRITES]


def test_rewrite_needs_no_shuffle(spark):
    rows = spark.range(10).select(F.lit("Food").alias("category"), F.lit("x").alias("subcategory"))
    plan = taxonomy.reformat_taxonomy(rows)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_split_category(spark):
    rows = spark.createDataFrame([("a:b",), ("a:",), ("a",), ("a:b:c",), (":b",), (None,)], "category string")
    found = [(r.category, r.subcategory) for r in cleaning.split_category(rows).collect()]
    assert found == [("a", "b"), ("a", "not provided"), ("a", "not provided"), ("a", "b"), ("", "b"), (None, None)]


def test_statement_amounts(spark):
    rows = spark.createDataFrame([
        (1, "-1,234.50", None), (2, None, '1,000.00",'), (3, "0", "0"), (4, "n/a", "5"),
        (5, None, None), (6, "-5", "5"), (7, "-5", "2.5"), (8, " -7 ", None), (9, "", "3")],
        "pos int, debit string, credit string")
    found = {r.pos: r.amount for r in cleaning.statement_amount(rows).collect()}
    assert found == {1: Decimal("-1234.50"), 2: 1000, 4: None, 7: Decimal("-2.50"), 8: -7, 9: None}


def test_statement_types(spark):
    kinds = {
        "Cash withdrawal": "Cash", "Cash Credit": "Cash", "Credit Transfer": "Electronic payment",
        "Debit Card Payment": "Debit card", "Standing Order": "Electronic payment",
        'SEPA ""Direct Debit""': "Electronic payment", "cash": "cash", '""Fee""': "Fee", None: None}
    rows = spark.createDataFrame([(k,) for k in kinds], "kind string")
    found = [r[0] for r in rows.select(cleaning.statement_type(F.col("kind"))).collect()]
    assert found == list(kinds.values())


def test_paymodes(spark):
    rows = spark.createDataFrame([("0",), ("8",), ("10",), ("x",), (None,)], "type string")
    assert [r.type for r in cleaning.map_paymode(rows).collect()] == ["Unknown", "Electronic payment", None, None, None]


def test_first_copy_stays_and_nulls_are_equal(ledger):
    rows = ledger({"category": None}, {"category": None}, {"category": "x"}, {"category": None, "payee": "other"})
    kept = dedup.first_of_each(rows.withColumnRenamed("tid", "pos"))
    assert sorted(r.pos for r in kept.collect()) == [0, 2]
    again = dedup.first_of_each(kept)
    assert sorted(r.pos for r in again.collect()) == [0, 2]


def test_known_rows_are_not_new_even_with_nulls(ledger):
    old = ledger({"type": None}, {"amount": 5})
    new = ledger({"type": None}, {"amount": 5}, {"amount": 6}, {"account_id": 2, "amount": 5})
    assert sorted(r.tid for r in dedup.new_rows(new, old).collect()) == [2, 3]


def test_duplicate_keys_ignore_nulls(ledger):
    rows = ledger({}, {}, {"category": None}, {"category": None}, {"amount": 3})
    assert [r.n_rows for r in validation.duplicate_keys(rows).collect()] == [2]


def test_normalise_transactions(spark):
    shape = ("date string, amount string, type string, description string, category string, "
             "subcategory string, tag string, status boolean, payee string")
    rows = spark.createDataFrame([
        ("1900-01-01", "12.345", "x" * 128, "x" * 129, "", None, "x" * 64, None, " "),
        ("1899-12-31", "abc", None, "d", "c", "s", "x" * 65, True, "p"),
        (None, None, "t", "d", "c", "s", "", False, "p")], shape)
    a, b, c = normalise.normalise_transactions(rows, AS_OF).collect()
    missing = "not provided"
    assert tuple(a) == (dt.date(1900, 1, 1), Decimal("12.35"), "x" * 128, missing, missing, missing, "x" * 64, False, " ")
    assert tuple(b) == (AS_OF, 0, missing, "d", "c", "s", missing, True, "p")
    assert (c.date, c.amount, c.tag) == (AS_OF, 0, missing)


def test_validation(spark):
    rows = spark.createDataFrame([
        (1, "a", "12", "EUR", "1.5"), (2, "", "1.5", "", "x"), (3, "a" * 129, None, "E" * 65, None)],
        "account_id int, name string, number string, currency string, balance string")
    assert [r.reject_reason for r in validation.validate_accounts(rows).orderBy("account_id").collect()] == [
        "", "name,number,currency,balance", "name,number,currency,balance"]
    people = spark.createDataFrame([("ann", "a@b.c"), ("a n", "a@b"), (None, "a @b.c")], "username string, email string")
    assert [r.reject_reason for r in validation.validate_users(people).collect()] == [
        "", "username,email", "username,email"]


@pytest.fixture
def staged(spark):
    shape = "tid long, account_id long, date date, amount decimal(18,2), type string, description string, beneficiary string"
    day = dt.date(2001, 1, 1)
    return spark.createDataFrame([
        (0, 1, day, Decimal(5), "Cash", "a", "b"), (1, 1, day, Decimal(5), "Cash", "a", "b"),
        (2, 1, day, Decimal(5), "Cash", "a", ""), (3, 2, day, Decimal(5), "Cash", "x" * 127, "b"),
        (4, 2, day, Decimal(6), "Cash", "a", None)], shape)


def test_promote(staged, ledger):
    old = ledger({"tid": 10, "date": dt.date(2001, 1, 1), "amount": 5, "description": "a  ",
                  "category": " ", "subcategory": " "}, {"tid": 3, "account_id": 9})
    rows = {r.tid: r for r in promote.promote_staging(staged, old, AS_OF).collect()}
    assert sorted(rows) == [11, 14, 15]
    assert (rows[11].description, rows[11].category, rows[11].tag, rows[11].status) == ("a  b", " ", " ", True)
    assert rows[14].description == "not provided"
    report = {r.account_id: tuple(r)[1:] for r in promote.promote_report(staged, old, AS_OF).collect()}
    assert report == {1: (1, 3, 1, 2, 2), 2: (0, 2, 2, 0, 2), 9: (1, 0, 0, 0, 1)}


def test_promote_into_an_empty_ledger(staged, ledger):
    assert sorted(r.tid for r in promote.promote_staging(staged, ledger({}).limit(0), AS_OF).collect()) == [0, 2, 3, 4]


def test_last_edit_wins_and_nulls_overwrite(ledger, spark):
    base = ledger({}, {}, {})
    change = base.where("tid < 2").withColumns({
        "seq": F.lit(1), "tag": F.lit("  x "), "status": F.lit(None).cast("boolean"), "payee": F.lit(None).cast("string")})
    later = change.where("tid = 1").withColumns({"seq": F.lit(2), "tag": F.lit("y")})
    rows = {r.tid: r for r in edits.apply_edits(base, change.unionByName(later)).collect()}
    assert [(rows[i].tag, rows[i].status, rows[i].payee) for i in range(3)] == [
        ("x ", False, None), ("y", False, None), ("t", True, "p")]


def test_budgets_for_accounts_without(spark):
    accounts = spark.createDataFrame([(1, "EUR"), (2, "USD")], "account_id long, currency string")
    own = spark.createDataFrame([(1, "x")], "account_id long, subject string")
    rows = budgets.seed_budgets(accounts, own, ["a", "b"]).collect()
    assert [(r.account_id, r.subject, r.limit_amount, r.unit, r["apply"]) for r in rows] == [
        (2, "a", 100, "USD", False), (2, "b", 100, "USD", False)]
    choices = budgets.effective_subjects(accounts, own, ["a", "b"]).collect()
    assert sorted(map(tuple, choices)) == [(1, "x"), (2, "a"), (2, "b")]


def test_refresh_keeps_what_was_not_seen(spark, ledger):
    shape = "account_id long, subject string, limit_amount decimal(18,2), last_month decimal(18,2), avg_month decimal(18,6), unit string, apply boolean"
    old = spark.createDataFrame(
        [(1, s, Decimal(1), Decimal(77), Decimal(88), "E", False) for s in ("now", "before", "never")], shape)
    rows = ledger(
        {"date": dt.date(2001, 6, 2), "amount": -4, "category": "now"},
        {"date": dt.date(2001, 6, 9), "amount": -6, "category": "now"},
        {"date": dt.date(2001, 1, 9), "amount": -2, "category": "now"},
        {"date": dt.date(2000, 7, 1), "amount": -8, "category": "before"},
        {"date": dt.date(2000, 6, 30), "amount": -100, "category": "before"},
        {"date": dt.date(2001, 6, 30), "amount": -3, "category": None},
        {"date": dt.date(2001, 6, 30), "amount": -3, "category": "no budget"})
    found = {r.subject: (r.last_month, r.avg_month) for r in budgets.refresh_budgets(old, rows, "category").collect()}
    assert found == {"now": (-10, -6.0), "before": (77, -8.0), "never": (77, 88.0)}


def test_post_and_reschedule(spark):
    day = dt.date
    shape = ("id long, account_id long, frequency string, interval_n int, day int, start_date date, end_date date, "
             "active boolean, last_approved date, amount decimal(18,2), description string, type string, "
             "category string, subcategory string, tag string, payee string")
    def schedule(i, active=True, frequency="Monthly"):
        return (i, 1, frequency, 1, 10, day(2001, 1, 5), day(2001, 12, 31), active, None, Decimal(-3), "d", "t", "c", "s", "", None)
    plans = spark.createDataFrame(
        [schedule(1), schedule(2), schedule(3, active=False), schedule(4, frequency="x"), schedule(5)], shape)
    said = spark.createDataFrame(
        [(1, True, None), (2, False, day(2001, 3, 3)), (3, True, None), (4, True, None), (5, True, day(2001, 1, 20))],
        "stid long, approve boolean, date date")
    posted, moved = schedules.post_due(plans, said, AS_OF)
    assert sorted((r.stid, r.date, r.status, r.type, r.tag, r.payee) for r in posted.collect()) == [
        (1, day(2001, 1, 10), True, "electronic", "not provided", "not provided"),
        (5, day(2001, 1, 20), True, "electronic", "not provided", "not provided")]
    assert {r.id: (r.start_date, r.last_approved) for r in moved.collect()} == {
        1: (day(2001, 1, 11), AS_OF), 2: (day(2001, 1, 5), None), 3: (day(2001, 1, 5), None),
        4: (day(2001, 1, 5), None), 5: (day(2001, 1, 21), AS_OF)}
    again = {r.id: r.start_date for r in schedules.reschedule(plans, said).collect()}
    assert again[2] == day(2001, 3, 3) and again[1] == day(2001, 1, 5)


def test_dimension_lists(spark):
    kinds = {"type": TYPES, "category": CATEGORIES, "subcategory": SUBCATEGORIES}
    rows = dimension_lists({k: dimension(spark, d) for k, d in kinds.items()}).collect()
    assert len(rows) == 10 + 21 + 47
    assert [r.name for r in rows if r.kind == "category"][:3] == ["Bills", "Education", "Finances"]
    assert dimension(spark, TYPES).where("id = 8").first().name == "Electronic payment"
