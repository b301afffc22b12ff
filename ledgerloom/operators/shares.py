"""Sums by period and subject, their pivots, and shares of income."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import month_label, month_of
from ledgerloom.functions.money import percent_half_up
from ledgerloom.operators.filters import trailing_cells
from ledgerloom.schema import MISSING

# Columns that a plan and its rows can carry; subjects in one row of a grouped pivot.
MOST_COLUMNS, GROUP_SUBJECTS = 10_000, 1_000


def subject_column(subject: str) -> Column:
    """Tags lose surrounding blanks; the others are taken as they are."""
    return F.trim("tag") if subject == "tag" else F.col(subject)


def spend_by_period(
    rows: DataFrame, subject: str, period: str = "month", trailing: int | None = None,
) -> DataFrame:
    """Net amount per account, period and subject; rows without a subject count
    for the trailing span but not for the sums."""
    by = month_of(F.col("date")) if period == "month" else F.year("date")
    cells = rows.groupBy(
        "account_id", by.alias(period), subject_column(subject).alias("subject"),
    ).agg(F.sum("amount").cast("decimal(28,2)").alias("net"))
    if trailing:
        cells = trailing_cells(cells, trailing)
    label = month_label(F.col("month")) if period == "month" else F.col("year")
    return cells.where(F.col("subject").isNotNull()).select(
        "account_id", label.alias("period"), "subject", "net")


def pivot(cells: DataFrame, values: Sequence[str] | None = None, other: str = "other") -> DataFrame:
    """One column per subject, 0 where there is nothing; the columns add up to the period's net. Name values to fix the
    columns, and to save the job that looks for them: the subjects not named then add up in the column `other`.
    More than MOST_COLUMNS subjects are refused before anything runs on them: see `pivot_groups`."""
    by_period = cells.groupBy("account_id", "period")
    if values is None:
        found = sorted(r[0] for r in cells.select("subject").distinct().limit(MOST_COLUMNS + 1).collect())
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} subjects: name values, or use pivot_groups")
        wide = by_period.pivot("subject", found).agg(F.first("net"))
        return wide.select("account_id", "period", *[
            F.coalesce(F.col(_quoted(c)), F.lit(0)).cast("decimal(28,2)").alias(c) for c in found])
    named = {v: F.col("subject") == v for v in values} | {other: ~F.col("subject").isin(*values)}
    return by_period.agg(*[
        F.sum(F.when(own, F.col("net")).otherwise(F.lit(0))).cast("decimal(28,2)").alias(name) for name, own in named.items()])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pivot_groups(cells: DataFrame, size: int = GROUP_SUBJECTS) -> DataFrame:
    """The pivot for any number of subjects: a row per account, period and group of subjects, with the nets of its subjects in one map.

    Subjects are dealt to groups by a hash, about `size` to a group, so a row stays of bounded size however many subjects there
    are. A subject has the same group in every period. A map holds what is not 0; all of them add up to the period's net.
    """
    groups = cells.select(F.ceil(F.count_distinct("subject") / F.lit(size)).alias("n")).scalar()
    group = F.pmod(F.xxhash64("subject"), F.greatest(groups, F.lit(1))).cast("int")
    return (cells.where(F.col("net") != 0).groupBy("account_id", "period", group.alias("subject_group"))
            .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("subject", "net")))).alias("nets")))


def percent_of_income(cells: DataFrame) -> DataFrame:
    """What share of the period's income each subject with a net outgo took.

    Income is the sum of the subjects with a net gain: an aggregate per account and period, joined back to the subjects.
    """
    gain = F.sum(F.greatest(F.col("net"), F.lit(0))).cast("decimal(28,2)")
    incomes = (cells.groupBy("account_id", "period").agg(gain.alias("income"))
               .select(F.col("account_id").alias("__account"), F.col("period").alias("__period"), "income"))
    # A period with very many subjects is split by the adaptive skew join.
    known = cells.join(incomes, F.col("account_id").eqNullSafe(F.col("__account")) & F.col("period").eqNullSafe(F.col("__period")))
    share = F.when(
        (F.col("net") < 0) & (F.col("income") > 0),
        percent_half_up(-F.col("net"), F.col("income")),
    ).otherwise(F.lit(0.0))
    return (known.where(F.col("subject") != MISSING)
            .select("account_id", "period", "subject", "income", share.alias("percent")))


def spend_share(cells: DataFrame) -> DataFrame:
    """Per subject, the sum of the outgo of its periods with a net outgo."""
    spent = F.sum(F.when(F.col("net") < 0, -F.col("net")).otherwise(F.lit(0)))
    return cells.groupBy("account_id", "subject").agg(spent.cast("decimal(28,2)").alias("spent"))
