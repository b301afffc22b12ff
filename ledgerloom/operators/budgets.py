"""Monthly averages, budgets and the budget gauge."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_label, month_of, months_back, row_order
from ledgerloom.operators.edits import latest_edit
from ledgerloom.operators.filters import trailing_cells
from ledgerloom.schema import MONEY, SUBJECTS

# The tag left out of incomes, and the gauge's scale.
NO_INCOME_TAG = "Superfuture"
INCOME_MONTHS = 24
EXPENSE_BUDGET, SUBJECT_BUDGET, GAUGE_TOTAL = 75, 100, 100
DEFAULT_LIMIT = 100


def _is_income() -> Column:
    return (F.col("amount") > 0) & ~F.col("tag").eqNullSafe(NO_INCOME_TAG)


def _months_with_income(rows: DataFrame) -> DataFrame:
    return rows.groupBy("account_id", month_of(F.col("date")).alias("month")).agg(
        F.sum(F.when(_is_income(), F.col("amount"))).alias("income"))


def _mean(total: Column, n: Column) -> Column:
    return total.cast("double") / n.cast("double")


def _mean_income() -> Column:
    """Mean over the months with income among the 24 up to `last_month`."""
    recent = F.when(F.col("month") >= months_back(F.col("last_month"), INCOME_MONTHS), F.col("income"))
    return F.when(F.count(recent) > 0, _mean(F.sum(recent), F.count(recent)))


def average_monthly_income(rows: DataFrame) -> DataFrame:
    """Per account; null without income. Give it the completed rows. The window
    groups one row per calendar month of an account."""
    last = F.max("month").over(Window.partitionBy("account_id"))
    return (_months_with_income(rows).withColumn("last_month", last)
            .groupBy("account_id").agg(_mean_income().alias("average_income")))


def _subject_months(rows: DataFrame, subject: str, months: int) -> DataFrame:
    cells = rows.groupBy(
        "account_id", month_of(F.col("date")).alias("month"), F.col(subject).alias("subject"),
    ).agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("decimal(28,2)").alias("net"))
    return trailing_cells(cells, months).where(F.col("subject").isNotNull())


def last_month(rows: DataFrame, subject: str) -> DataFrame:
    """Net amount of each subject in the month of the account's last row."""
    return _subject_months(rows, subject, 1).select("account_id", "subject", F.col("net").alias("last_month"))


def average_month(rows: DataFrame, subject: str) -> DataFrame:
    """Mean monthly net over the last 12 months, counting the months with rows."""
    return (_subject_months(rows, subject, 12).groupBy("account_id", "subject")
            .agg(_mean(F.sum("net"), F.count(F.lit(1))).alias("avg_month")))


def refresh_budgets(budgets: DataFrame, rows: DataFrame, subject: str) -> DataFrame:
    """Budgets with fresh last-month and average values; a subject that was not
    seen keeps its old value, one without a budget is left out."""
    fresh = _subject_months(rows, subject, 12).groupBy("account_id", "subject").agg(
        F.sum(F.when(F.col("month") == F.trunc("last_month", "MM"), F.col("net"))).cast(MONEY).alias("new_last"),
        _mean(F.sum("net"), F.count(F.lit(1))).alias("new_avg"),
    )
    return budgets.join(fresh, ["account_id", "subject"], "left").select(
        "account_id", "subject", "limit_amount",
        F.coalesce("new_last", "last_month").alias("last_month"),
        F.coalesce("new_avg", F.col("avg_month").cast("double")).alias("avg_month"),
        "unit", "apply",
    )


def seed_budgets(accounts: DataFrame, budgets: DataFrame, names: Iterable[str]) -> DataFrame:
    """Default budgets for the accounts that have none: one per name."""
    without = accounts.join(budgets.select("account_id").distinct(), "account_id", "left_anti")
    return without.select(
        "account_id",
        F.explode(F.array(*[F.lit(n) for n in names])).alias("subject"),
        F.lit(DEFAULT_LIMIT).cast(MONEY).alias("limit_amount"),
        F.lit(0).cast(MONEY).alias("last_month"),
        F.lit(0).cast("decimal(18,6)").alias("avg_month"),
        F.col("currency").alias("unit"),
        F.lit(False).alias("apply"),
    )


def effective_subjects(accounts: DataFrame, budgets: DataFrame, names: Iterable[str]) -> DataFrame:
    """The choices of each account: its own budgets, or all names if it has none."""
    own = accounts.select("account_id").join(budgets.select("account_id", "subject"), "account_id")
    return own.unionByName(seed_budgets(accounts, budgets, names).select("account_id", "subject"))


def budget_listing(category_budgets: DataFrame, subcategory_budgets: DataFrame) -> DataFrame:
    return (category_budgets.withColumn("kind", F.lit("category"))
            .unionByName(subcategory_budgets.withColumn("kind", F.lit("subcategory"))))


def upsert_budgets(budgets: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited limits and flags; an edit of an unknown subject adds a budget."""
    base, new = budgets.alias("b"), latest_edit(edits, ["account_id", "subject"]).alias("e")
    key = (F.col("b.account_id") == F.col("e.account_id")) & (F.col("b.subject") == F.col("e.subject"))
    old, is_edit = F.col("b.account_id").isNotNull(), F.col("e.account_id").isNotNull()
    return base.join(new, key, "full").select(
        F.coalesce("b.account_id", "e.account_id").alias("account_id"),
        F.coalesce("b.subject", "e.subject").alias("subject"),
        F.when(is_edit, F.col("e.limit_amount")).otherwise(F.col("b.limit_amount")).alias("limit_amount"),
        F.coalesce("b.last_month", F.lit(0)).cast(MONEY).alias("last_month"),
        F.coalesce("b.avg_month", F.lit(0)).cast("decimal(18,6)").alias("avg_month"),
        F.when(old, F.col("b.unit")).otherwise(F.col("e.unit")).alias("unit"),
        F.when(is_edit, F.col("e.apply")).otherwise(F.col("b.apply")).alias("apply"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 unless the whole is above zero."""
    whole = whole.cast("double")
    return F.when(whole > 0, part.cast("double") * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def budget_gauge(
    accounts: DataFrame,
    rows: DataFrame,
    category_budgets: DataFrame,
    subcategory_budgets: DataFrame,
    as_of: dt.date,
) -> DataFrame:
    """How far each account is through its month; give it the completed rows.

    The month is that of `as_of`, or the account's latest. The subjects are those
    of the month's most recent row. One pass over the rows makes sums by account,
    month and subjects; everything else works on those.
    """
    base = rows.dropna(subset=["account_id", "date"]).groupBy(
        "account_id", month_of(F.col("date")).alias("month"), *SUBJECTS,
    ).agg(
        F.sum(F.when(F.col("amount") < 0, F.col("amount"))).alias("outgo"),
        F.sum(F.when(F.col("amount") > 0, F.col("amount"))).alias("gain"),
        F.max(row_order(F.col("date"), F.col("tid"), lowest_id_last=True)).alias("newest"),
    )
    counted = F.when(~F.col("tag").eqNullSafe(NO_INCOME_TAG), F.col("gain"))
    months = base.groupBy("account_id", "month").agg(
        F.sum(counted).alias("income"),
        F.sum("outgo").alias("outgo"),
        F.max_by(F.struct(*SUBJECTS), "newest").alias("shown"),
    )
    # Windows over one row per calendar month of an account.
    per_account = Window.partitionBy("account_id")
    this_month = F.when(F.col("month") == F.lit(as_of.replace(day=1)), F.col("month"))
    wanted = F.coalesce(F.max(this_month).over(per_account), F.max("month").over(per_account))
    gauge = (
        months.withColumns({"wanted": wanted, "last_month": F.max("month").over(per_account)})
        .groupBy("account_id", F.col("wanted").alias("month"))
        .agg(_mean_income().alias("average_income"),
             F.max(F.when(F.col("month") == F.col("wanted"), F.col("outgo"))).alias("spent"),
             F.max(F.when(F.col("month") == F.col("wanted"), F.col("shown"))).alias("shown"))
        .select("account_id", "month", "average_income", F.coalesce("spent", F.lit(0)).alias("spent"),
                *[F.col(f"shown.{s}").alias(f"this_{s}") for s in SUBJECTS])
    )
    # Joined by account and month, so that a large account is spread by month.
    # With the same filters and columns (`newest` too) both uses share one shuffle.
    net = F.coalesce("outgo", F.lit(0)) + F.coalesce("gain", F.lit(0))
    joined = (
        base.where(F.col("newest").isNotNull()).join(gauge, ["account_id", "month"])
        .groupBy(*gauge.columns)
        .agg(*[F.abs(F.coalesce(F.sum(F.when(F.col(s) == F.col(f"this_{s}"), net)), F.lit(0)))
               .alias(f"{s}_spend") for s in SUBJECTS])
    )

    def limits(budgets: DataFrame, subject: str) -> DataFrame:
        return budgets.select(
            "account_id", F.col("subject").alias(f"this_{subject}"),
            F.col("limit_amount").alias(f"{subject}_limit"), F.col("apply").alias(f"{subject}_apply"))

    joined = (
        joined
        .join(limits(category_budgets, "category"), ["account_id", "this_category"], "left")
        .join(limits(subcategory_budgets, "subcategory"), ["account_id", "this_subcategory"], "left")
    )

    def budgeted(subject: str) -> Column:
        spend, apply = F.col(f"{subject}_spend"), F.col(f"{subject}_apply")
        return (F.when(apply, _ratio(spend, F.col(f"{subject}_limit")))
                .when(~apply, _ratio(spend, F.col("average_income"))).otherwise(F.lit(0.0)))

    measured = joined.select(
        "account_id",
        month_label(F.col("month")).alias("period"),
        _ratio(F.abs("spent"), F.col("average_income")).alias("expense_spent_pct"),
        F.col("this_tag").alias("tag"),
        _ratio(F.col("tag_spend"), F.col("average_income")).alias("tag_pct"),
        F.col("this_category").alias("category"),
        budgeted("category").alias("category_pct"),
        F.col("this_subcategory").alias("subcategory"),
        budgeted("subcategory").alias("subcategory_pct"),
        F.lit(True).alias("has_rows"),
    )
    text = [F.when(F.col("has_rows"), F.col(s)).otherwise(F.lit("")).alias(s) for s in SUBJECTS]
    pct = [F.coalesce(f"{s}_pct", F.lit(0.0)).alias(f"{s}_pct") for s in ["expense_spent", *SUBJECTS]]
    return accounts.select("account_id").join(measured, "account_id", "left").select(
        "account_id", "period", *text, *pct,
        F.lit(EXPENSE_BUDGET).alias("expense_budget"),
        F.lit(SUBJECT_BUDGET).alias("subject_budget"),
        F.lit(GAUGE_TOTAL).alias("total"),
    )
