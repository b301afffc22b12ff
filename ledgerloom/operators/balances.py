"""Account overview, running balances and period-closing balances."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_label, month_of, row_order
from ledgerloom.operators.filters import trailing_cells
from ledgerloom.plans.skew import running_total

# Stands for the month of rows without a date; before every accepted date.
NO_MONTH = dt.date(1800, 1, 1)


def account_overview(accounts: DataFrame, rows: DataFrame) -> DataFrame:
    """Per account: rows, pending rows and closing balance over completed rows."""
    done = F.col("status") & F.col("status").isNotNull()
    totals = rows.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(done).alias("done"),
        F.sum(F.when(done, F.col("amount"))).alias("moved"),
    )
    return overview_of(accounts, totals)


def overview_of(accounts: DataFrame, totals: DataFrame) -> DataFrame:
    """The overview from each account's `total` and `done` rows and the sum `moved` of the done ones."""
    return accounts.join(totals, "account_id", "left").select(
        "account_id",
        F.col("name").alias("account_name"),
        F.col("balance").alias("opening_balance"),
        F.coalesce("total", F.lit(0)).alias("total_transactions"),
        (F.coalesce("total", F.lit(0)) - F.coalesce("done", F.lit(0))).alias("pending_transactions"),
        (F.col("balance") + F.coalesce("moved", F.lit(0))).cast("decimal(28,2)").alias("closing_balance"),
        F.col("currency").alias("account_currency"),
    )


def portfolio_total(accounts: DataFrame, rows: DataFrame) -> DataFrame:
    """Sum of all closing balances and of all ledger amounts."""
    overview = account_overview(accounts, rows)
    closing = overview.agg(F.sum("closing_balance").cast("decimal(38,2)").alias("total"))
    booked = rows.agg(F.sum("amount").cast("decimal(38,2)").alias("total"))
    return closing.select(
        F.coalesce("total", F.lit(0)).cast("decimal(38,2)").alias("closing_total"),
        F.coalesce(booked.scalar(), F.lit(0)).cast("decimal(38,2)").alias("ledger_total"))


def running_balance(rows: DataFrame, openings: DataFrame) -> DataFrame:
    """Balance after each row, oldest first; give it the completed rows."""
    return running_total(rows, openings)


def ledger_log(rows: DataFrame, openings: DataFrame) -> DataFrame:
    """The listing: all rows, tags trimmed, balance added up from the newest row."""
    listed = rows.withColumn("tag", F.trim("tag"))
    return running_total(listed, openings, newest_first=True)


def _with_opening(sums: DataFrame, openings: DataFrame, period: str) -> DataFrame:
    """Closing balance of each period from per-period sums.

    One row per account and calendar period, so a window group is bounded by the
    number of months in the accepted dates, however large the account is.
    """
    so_far = F.sum("net").over(
        Window.partitionBy("account_id").orderBy(period)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (sums.withColumn("so_far", so_far).join(openings, "account_id", "left")
            .withColumn("closing_balance",
                        (F.coalesce("opening", F.lit(0)) + F.coalesce("so_far", F.lit(0))).cast("decimal(28,2)")))


def closing_by_year(rows: DataFrame, openings: DataFrame) -> DataFrame:
    sums = rows.groupBy("account_id", F.year("date").alias("year")).agg(F.sum("amount").alias("net"))
    return _with_opening(sums, openings, "year").select("account_id", "year", "closing_balance")


def closing_by_month(rows: DataFrame, openings: DataFrame, trailing: int | None = None) -> DataFrame:
    """Balance at the end of each month that has rows; `trailing` keeps the last months."""
    sums = rows.groupBy("account_id", month_of(F.col("date")).alias("month")).agg(F.sum("amount").alias("net"))
    closed = _with_opening(sums, openings, "month").select("account_id", "month", "closing_balance")
    if trailing:
        closed = trailing_cells(closed, trailing)
    return closed.select("account_id", month_label(F.col("month")).alias("yearmonth"), "closing_balance")


def closing_by_month_outgo(rows: DataFrame, openings: DataFrame, trailing: int | None = None) -> DataFrame:
    """Balance at the last outgo row of each month: months without outgo are
    missing and income after the last outgo is not in the month's balance."""
    # Rows without a date come first, as a month of their own.
    dated = rows.withColumns({
        "__month": F.coalesce(month_of(F.col("date")), F.lit(NO_MONTH)),
        "__place": row_order(F.coalesce("date", F.lit(NO_MONTH)), F.coalesce("tid", F.lit(-1)))})
    spent = ~F.coalesce(F.col("amount") > 0, F.lit(False))
    months = dated.groupBy("account_id", "__month").agg(
        F.max(F.when(spent, F.col("__place"))).alias("__last"), F.sum("amount").alias("net"))
    # Of a month's rows only those up to its last outgo count; the months before count in full.
    # A month with very many rows is split by the adaptive skew join.
    lasts = months.where("__last is not null").select(F.col("account_id").alias("__account"), F.col("__month").alias("__of"), "__last")
    same = F.col("account_id").eqNullSafe(F.col("__account")) & (F.col("__month") == F.col("__of")) & (F.col("__place") <= F.col("__last"))
    upto = dated.join(lasts, same).groupBy("account_id", "__month").agg(F.sum("amount").alias("upto"))
    before = F.sum("net").over(Window.partitionBy("account_id").orderBy("__month").rowsBetween(Window.unboundedPreceding, -1))
    closed = (months.withColumn("before", F.coalesce(before, F.lit(0))).where("__last is not null").alias("m")
              .join(upto.alias("u"), F.expr("m.account_id <=> u.account_id and m.__month = u.__month"))
              .select("m.account_id", F.nullif("m.__month", F.lit(NO_MONTH)).alias("month"), "before", "upto")
              .join(openings, "account_id", "left")
              .select("account_id", "month", (F.coalesce("opening", F.lit(0)) + F.col("before") + F.coalesce("upto", F.lit(0)))
                      .cast("decimal(28,2)").alias("closing_balance")))
    if trailing:
        closed = trailing_cells(closed, trailing)
    return closed.select("account_id", month_label(F.col("month")).alias("yearmonth"), "closing_balance")
