"""Batches of edits and deletions applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.schema import MONEY

LEDGER_FIELDS = ["date", "amount", "type", "description", "category", "subcategory", "tag", "status", "payee"]
STAGING_FIELDS = ["date", "amount", "type", "description", "beneficiary"]
SCHEDULE_FIELDS = ["frequency", "interval_n", "day", "start_date", "end_date", "active", "amount",
                   "type", "description", "category", "subcategory", "payee"]


def latest_edit(edits: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """The last edit of each row, by its sequence number."""
    if order not in edits.columns:
        return edits
    others = [c for c in edits.columns if c not in (*keys, order)]
    last = F.max_by(F.struct(*others), F.col(order))
    return edits.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.*")


def _apply(
    base: DataFrame, edits: DataFrame, keys: Sequence[str], fields: Sequence[str],
    rules: dict[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Fields of the edited rows replaced, other rows untouched. The keys are
    unique, so the join neither multiplies rows nor meets a hot key."""
    rules = rules or {}
    edits = latest_edit(edits, keys)
    new = edits.select(*keys, F.struct(*[
        rules.get(f, lambda c: c)(F.col(f)).alias(f) for f in fields]).alias("edit"))
    edited = F.col("edit").isNotNull()
    return base.join(new, list(keys), "left").select(*[
        F.when(edited, F.col(f"edit.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
        for c in base.columns])


def apply_edits(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """Ledger edits by (account_id, tid): tags lose leading blanks, and only a
    true status completes a row."""
    return _apply(ledger, edits, ["account_id", "tid"], LEDGER_FIELDS, {
        "tag": lambda c: F.ltrim(c), "status": lambda c: c.eqNullSafe(True)})


def apply_status(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    return _apply(ledger, edits, ["tid"], ["status"], {"status": lambda c: c.eqNullSafe(True)})


def apply_staging_edits(staging: DataFrame, edits: DataFrame) -> DataFrame:
    return _apply(staging, edits, ["account_id", "tid"], STAGING_FIELDS)


def apply_schedule_edits(schedules: DataFrame, edits: DataFrame) -> DataFrame:
    """Every field of the template but the tag and the approval."""
    return _apply(schedules, edits, ["account_id", "id"], SCHEDULE_FIELDS)


def apply_account_edits(accounts: DataFrame, edits: DataFrame) -> DataFrame:
    """Name, currency and opening balance; `changed` tells the rows that differ."""
    fields = ["name", "currency", "balance"]
    new = latest_edit(edits, ["account_id"]).select("account_id", F.struct(
        "name", "currency", F.col("balance").cast(MONEY).alias("balance")).alias("edit"))
    edited = F.col("edit").isNotNull()
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f).eqNullSafe(F.col(f"edit.{f}"))
    return accounts.join(new, "account_id", "left").select(
        *[F.when(edited, F.col(f"edit.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
          for c in accounts.columns],
        (edited & differs).alias("changed"))


def delete_rows(rows: DataFrame, deletions: DataFrame, key: str = "tid") -> DataFrame:
    return rows.join(deletions.select(key), key, "left_anti")
