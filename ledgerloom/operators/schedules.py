"""Recurring payments: due dates, upcoming rows, posting and rescheduling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.recurrence import next_due
from ledgerloom.operators.normalise import normalise_transactions

# Fixed value: the type of an upcoming row.
UPCOMING_TYPE = "electronic"


def _due() -> Column:
    return next_due(F.col("frequency"), F.col("interval_n"), F.col("day"),
                    F.col("start_date"), F.col("end_date"))


def with_due(schedules: DataFrame) -> DataFrame:
    """`due`: the next date of each schedule, null if there is none."""
    return schedules.withColumn("due", _due())


def upcoming(schedules: DataFrame) -> DataFrame:
    """Active schedules with a next date, as rows that are still open.

    The date is exploded from a list of one or none, so that the rule is worked out
    once; a filter on it would have it worked out again.
    """
    return schedules.where("active").select(
        F.col("id").alias("stid"), "account_id",
        F.explode(F.array_compact(F.array(_due()))).alias("date"), "amount",
        F.lit(UPCOMING_TYPE).alias("type"), "description", "category", "subcategory", "tag",
        F.lit(False).alias("status"), "payee")


def listed_upcoming(schedules: DataFrame) -> DataFrame:
    """`upcoming`, newest first."""
    return upcoming(schedules).orderBy(F.desc("date"), "account_id", "stid")


def post_due(schedules: DataFrame, decisions: DataFrame, as_of: dt.date) -> tuple[DataFrame, DataFrame]:
    """Ledger rows for the approved dates, and the schedules moved past them.

    `decisions` has (stid, approve, date), one per schedule; a null date means the
    one that was due. Approved schedules start again the day after; the others
    keep theirs (`reschedule` moves those).
    """
    approved = upcoming(schedules).join(
        decisions.where("approve").select("stid", F.col("date").alias("chosen")), "stid")
    posted = normalise_transactions(
        approved.withColumn("date", F.coalesce("chosen", "date"))
        .withColumn("status", F.lit(True)).drop("chosen"), as_of)
    moved = posted.select(F.col("stid").alias("id"), F.date_add("date", 1).alias("next_start"))
    is_moved = F.col("next_start").isNotNull()
    advanced = schedules.join(moved, "id", "left").withColumns({
        "last_approved": F.when(is_moved, F.lit(as_of)).otherwise(F.col("last_approved")),
        "start_date": F.coalesce("next_start", "start_date"),
    }).select(*schedules.columns)
    return posted, advanced


def reschedule(schedules: DataFrame, decisions: DataFrame) -> DataFrame:
    """Schedules that were not approved start at the given date."""
    given = decisions.where(~F.col("approve") & F.col("date").isNotNull()).select(
        F.col("stid").alias("id"), F.col("date").alias("next_start"))
    return schedules.join(given, "id", "left").withColumn(
        "start_date", F.coalesce("next_start", "start_date")).select(*schedules.columns)


def schedule_listing(schedules: DataFrame) -> DataFrame:
    return schedules.select(
        "id", "account_id", "frequency", "interval_n", "day", "start_date", "end_date",
        F.col("last_approved").alias("approved"), "amount", "category", "subcategory",
        "payee", "description", "active").orderBy("id")
