"""Reviewed statement rows moved into the ledger."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.dedup import first_of_each, new_rows
from ledgerloom.operators.normalise import normalise_transactions
from ledgerloom.schema import LEDGER, MISSING

# Fixed value: what a promoted row has for category, subcategory and tag.
BLANK = " "


def promote_staging(staging: DataFrame, ledger: DataFrame, as_of: dt.date) -> DataFrame:
    """The staged rows the ledger does not have yet, as completed ledger rows.

    New ids continue after the ledger's greatest: staged ids are unique, so adding
    that offset keeps them unique without numbering rows in one place.
    """
    greatest = ledger.agg(F.max("tid").alias("tid")).scalar()
    rows = staging.select(
        F.col("tid").alias("pos"),
        "account_id", "date", "amount", "type",
        F.concat(F.coalesce("description", F.lit("")), F.lit("  "),
                 F.coalesce("beneficiary", F.lit(""))).alias("description"),
        F.lit(BLANK).alias("category"),
        F.lit(BLANK).alias("subcategory"),
        F.lit(BLANK).alias("tag"),
        F.lit(True).alias("status"),
        F.lit(MISSING).alias("payee"),
    )
    fresh = new_rows(first_of_each(normalise_transactions(rows, as_of)), ledger)
    return fresh.withColumn(
        "tid", F.coalesce(greatest, F.lit(-1)) + 1 + F.col("pos")).select(*LEDGER.fieldNames())


def promote_report(staging: DataFrame, ledger: DataFrame, as_of: dt.date) -> DataFrame:
    """Per account: rows before, staged, added, left out as duplicates, and after."""
    kinds = {"transactions_before": ledger, "to_be_added": staging, "added": promote_staging(staging, ledger, as_of)}
    marked = [rows.select("account_id", *[F.lit(int(k == name)).alias(k) for k in kinds]) for name, rows in kinds.items()]
    # One aggregate of all rows, each counted in one column.
    counts = reduce(DataFrame.unionByName, marked).groupBy("account_id").agg(*[F.sum(k).alias(k) for k in kinds])
    return counts.select(
        "account_id", "transactions_before", "to_be_added", "added",
        (F.col("to_be_added") - F.col("added")).alias("duplicates"),
        (F.col("transactions_before") + F.col("added")).alias("transactions_after"))


def staging_left(staging: DataFrame, promoted: DataFrame) -> DataFrame:
    """What stays staged once the rows of the accounts in `promoted` have been moved: added or known already, they leave."""
    return staging.join(promoted.select("account_id").distinct(), "account_id", "left_anti").select(*staging.columns)


def staging_listing(staging: DataFrame) -> DataFrame:
    return staging.select(
        "tid", "account_id", F.to_date("date").alias("date"), "amount", "type",
        "description", "beneficiary").orderBy("tid")
