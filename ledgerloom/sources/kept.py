"""Sums of a stored ledger, kept up to date from version to version.

The sums are by account, month and the three subjects: rows, completed gains and outgoes, and their amounts. `catch_up` compares the folders of
the ledger's newest version with those of the version that the sums were last brought to: rows of new folders are added, rows of
folders that are gone are taken away. Folders never change, so this holds for batches, replaced batches, edits, deletions and
promotions alike, and no folder that stayed is opened. Each version of the sums notes the ledger's version it stands for; a run that
broke off is repeated without harm, and of two runs at once the second is refused.

Differences are folders of their own beside the base, added up on reading. When they have more cells than the base, all are written as
a new base, so a cell is rewritten a few times however many batches come. Amounts are decimals: taking away what was added leaves nothing.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.dates import month_of
from ledgerloom.operators import balances, filters
from ledgerloom.plans.workspace import empty
from ledgerloom.schema import LEDGER, SUBJECTS
from ledgerloom.sources import stores, versions
from ledgerloom.sources.versions import Folder, Version

AMOUNT = T.DecimalType(28, 2)
KEYS = ["account_id", "month", *SUBJECTS]
COUNTS, AMOUNTS = ["n", "gains", "outgoes"], ["gain", "outgo"]
CELLS = T.StructType([
    T.StructField("account_id", T.LongType()), T.StructField("month", T.DateType()), *[T.StructField(s, T.StringType()) for s in SUBJECTS],
    *[T.StructField(c, T.LongType()) for c in COUNTS], *[T.StructField(a, AMOUNT) for a in AMOUNTS]])
# Noted in a version of the sums: the ledger's version they stand for.
STANDS_FOR = "ledger"


class LedgerBehind(RuntimeError):
    """The sums stand for another version of the ledger than the one asked for: call `catch_up`."""


def cells_of(rows: DataFrame, sign: int | Column = 1) -> DataFrame:
    """Sums of ledger rows, or what takes them away with a sign of -1, which may be a column of the rows. Rows without a date have the month null."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    done = F.coalesce("status", F.lit(False))
    up = F.coalesce(F.col("amount") > 0, F.lit(False))

    def count(which: Column) -> Column:
        return F.sum(F.when(which, sign).otherwise(F.lit(0)))

    def amount(which: Column) -> Column:
        signed = F.when(sign < 0, -F.col("amount")).otherwise(F.col("amount"))
        return F.coalesce(F.sum(F.when(which, signed)), F.lit(0)).cast(AMOUNT)

    return rows.groupBy("account_id", month_of(F.col("date")).alias("month"), *SUBJECTS).agg(
        F.sum(sign).alias("n"), count(done & up).alias("gains"), count(done & ~up).alias("outgoes"),
        amount(done & up).alias("gain"), amount(done & ~up).alias("outgo"))


# A cell that has come to nothing is left out.
SOME = " or ".join(f"{c} <> 0" for c in COUNTS + AMOUNTS)


def _added_up(cells: DataFrame) -> DataFrame:
    """One row per cell."""
    sums = [F.sum(c).alias(c) for c in COUNTS] + [F.sum(a).cast(AMOUNT).alias(a) for a in AMOUNTS]
    return cells.groupBy(*KEYS).agg(*sums).where(SOME)


def _stored(spark: SparkSession, path: str, folders: tuple[Folder, ...]) -> DataFrame:
    if not folders:
        return empty(spark, CELLS)
    return spark.read.schema(CELLS).parquet(*[f"{path}/{f.path}" for f in folders])


def _write(cells: DataFrame, path: str, lot: str) -> Folder:
    """One folder, its files ordered by account, so that a read of one account opens few."""
    folder = Folder(uuid.uuid4().hex, None, lot, "sums", 0, 0, 0, 0, 0, None, None)
    cells.repartitionByRange(*KEYS).sortWithinPartitions("account_id", "month").write.parquet(f"{path}/{folder.path}")
    held = _stored(cells.sparkSession, path, (folder,)).agg(
        F.count(F.lit(1)).alias("rows"), F.min("account_id").alias("first_account"), F.max("account_id").alias("last_account")).first()
    return replace(folder, **held.asDict())


def catch_up(spark: SparkSession, ledger: str, path: str) -> Version:
    """Bring the sums below `path` to the newest version of the ledger. The first time, and when the version they stand for was
    removed from the ledger, they are made anew from all rows."""
    now, kept = versions.read(spark, ledger), versions.read(spark, path) or Version(0)
    if now is None:
        raise FileNotFoundError(f"{ledger} is no store")
    seen = kept.runs.get(STANDS_FOR)
    if seen == now.number:
        return kept
    before = None if seen is None else versions.read(spark, ledger, seen)
    if before is None:
        kept, before = replace(kept, folders=()), Version(0)
    gone, new = set(before.folders) - set(now.folders), set(now.folders) - set(before.folders)
    after = replace(kept, runs={STANDS_FOR: now.number})
    if gone or new:
        # Rows that went and rows that came are added up in one aggregate: most of them are the same after an edit.
        moved = [stores.rows_of(spark, ledger, LEDGER, some).withColumn("__sign", F.lit(sign)) for some, sign in ((new, 1), (gone, -1)) if some]
        part = cells_of(reduce(DataFrame.unionByName, moved), F.col("__sign")).where(SOME)
        after = after.with_folders([_write(part, path, "difference" if kept.folders else "base")])
    base, *differences = after.folders or (None,)
    if sum(f.rows for f in differences) > (base.rows if base else 0):
        after = replace(after, folders=(_write(_added_up(_stored(spark, path, after.folders)), path, "base"),))
    return versions.publish(spark, path, after)


def stands_for(spark: SparkSession, path: str) -> int:
    """The version of the ledger that the sums stand for."""
    kept = versions.read(spark, path)
    if kept is None:
        raise FileNotFoundError(f"{path} has no sums")
    return kept.runs[STANDS_FOR]


def read_cells(spark: SparkSession, path: str, account: int | None = None) -> DataFrame:
    """The sums, one row per account, month and subjects; of one account if given."""
    kept = versions.read(spark, path)
    if kept is None:
        raise FileNotFoundError(f"{path} has no sums")
    # A folder without rows, or with null accounts alone, has no bounds.
    near = [f for f in kept.folders if account is None or (f.first_account is not None and f.first_account <= account <= f.last_account)]
    cells = _stored(spark, path, tuple(near))
    return _added_up(cells if account is None else cells.where(F.col("account_id") == account))


def as_rows(cells: DataFrame) -> DataFrame:
    """The sums as completed ledger rows dated the first of their month: up to two per cell, its gains and its outgoes.

    Whatever works on sums by month or year and tells gains from outgoes gives the same answer for these as for the ledger:
    spending by period, pivots, shares, averages, budgets and closing balances (not the `_outgo` ones, which need the order of the rows).
    A null amount counts as 0.
    """
    parts = F.array(*[F.when(F.col(count) > 0, F.struct(F.col(amount).alias("amount"))) for count, amount in (("gains", "gain"), ("outgoes", "outgo"))])
    return cells.select("account_id", F.col("month").alias("date"), *SUBJECTS, F.explode(F.array_compact(parts)).alias("__part")).select(
        "account_id", "date", "__part.amount", *SUBJECTS, F.lit(True).alias("status"))


def account_overview(accounts: DataFrame, cells: DataFrame) -> DataFrame:
    """`balances.account_overview` from the sums."""
    return balances.overview_of(accounts, cells.groupBy("account_id").agg(
        F.sum("n").alias("total"), F.sum(F.col("gains") + F.col("outgoes")).alias("done"), F.sum(F.col("gain") + F.col("outgo")).alias("moved")))


def openings_at(cells: DataFrame, openings: DataFrame, month: dt.date) -> DataFrame:
    """The balance of each account at the beginning of a month; rows without a date lie before every month."""
    earlier = F.col("month").isNull() | (F.col("month") < F.lit(month))
    moved = cells.where(earlier).groupBy("account_id").agg(F.sum(F.col("gain") + F.col("outgo")).alias("moved"))
    return moved.join(openings, "account_id", "full").select(
        "account_id", (F.coalesce("opening", F.lit(0)) + F.coalesce("moved", F.lit(0))).cast(AMOUNT).alias("opening"))


def running_balance_since(
    spark: SparkSession, ledger: str, path: str, openings: DataFrame, first: dt.date, last: dt.date | None = None, account: int | None = None,
) -> DataFrame:
    """`balances.running_balance` of the completed rows from `first` on (to `last`, of one account), reading the folders of that span alone: what
    lies before the month of `first` is taken from the sums. A row dated back into an earlier month is in the sums as soon as
    they have caught up; until then this fails with LedgerBehind."""
    if versions.numbers(spark, ledger)[-1:] != [stands_for(spark, path)]:
        raise LedgerBehind(f"the sums below {path} stand for version {stands_for(spark, path)} of {ledger}")
    month = first.replace(day=1)
    rows = filters.completed(stores.read_ledger(spark, ledger, month, last, account, version=stands_for(spark, path)))
    before = openings_at(read_cells(spark, path, account), openings, month)
    return balances.running_balance(rows, before).where(F.col("date") >= F.lit(first))
