"""Staged rows and due payments moved into a ledger, two stores changed as one step; budgets refreshed from a ledger's sums."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.budgets import refresh_budgets, upsert_budgets
from ledgerloom.operators.edits import apply_schedule_edits
from ledgerloom.operators.promote import promote_staging
from ledgerloom.operators.schedules import post_due, reschedule
from ledgerloom.schema import STAGING
from ledgerloom.sources import kept, stores, versions
from ledgerloom.sources.keyed import budgets_at, schedules_at


def _staged(spark: SparkSession, path: str, number: int | None, accounts: DataFrame | None) -> DataFrame:
    rows = stores.read_staging(spark, path, number)
    return rows if accounts is None else rows.join(accounts.select("account_id").distinct(), "account_id", "left_semi").select(*rows.columns)


def promote_store(
    spark: SparkSession, staging: str, ledger: str, as_of: dt.date, run: str, accounts: DataFrame | None = None,
) -> int:
    """Move the staged rows of the accounts (of all, if not given) into the ledger: those it does not have yet are added, and all
    leave the staging store. Returns the number of staged rows that left.

    The version of the ledger that has the new rows notes the run and the version of the staged rows it took. If a run that broke off after it is
    repeated, the ledger stays as it is and exactly those staged rows leave: neither rows staged since nor the ledger suffer. A run that
    has ended changes nothing when repeated.
    """
    at = versions.read(spark, staging)
    if at is None:
        raise FileNotFoundError(f"{staging} is no store")
    known = versions.read(spark, ledger)
    taken = known.runs.get(run) if known else None
    if taken is None:
        taken = at.number
        stored = stores.ledger_rows(stores.open_store(spark, ledger, missing_ok=True))
        fresh = promote_staging(_staged(spark, staging, taken, accounts), stored, as_of)
        stores.append_rows(fresh, ledger, f"promoted-{run}", run=(run, taken))
    return leave_staging(spark, staging, taken, accounts)


def leave_staging(spark: SparkSession, staging: str, taken: int, accounts: DataFrame | None = None) -> int:
    """The second half: rows that were staged in version `taken` leave the newest version."""
    gone = _staged(spark, staging, taken, accounts).select("tid")
    before = sum(f.rows for f in versions.read(spark, staging).folders)
    stores.remove_rows(spark, staging, gone, STAGING)
    return before - sum(f.rows for f in versions.read(spark, staging).folders)


def post_due_store(spark: SparkSession, schedules: str, ledger: str, decisions: DataFrame, as_of: dt.date, run: str) -> None:
    """Post the approved payments of stored schedules to a stored ledger, and store the schedules moved past them; those not
    approved start at the date given. `decisions` as for `post_due`.

    The ledger's version notes the run and the version of the schedules it was made from. A run that broke off between the two stores,
    when repeated, posts nothing again and moves the schedules from that version; one that has ended changes nothing. Schedules edited in
    between keep their edits and only get the new dates.
    """
    store = schedules_at(spark, schedules)
    known = versions.read(spark, ledger)
    taken = known.runs.get(f"due {run}") if known else None
    if taken is None:
        if f"run {run}" in store.version().runs:
            return
        taken = store.version().number
        posted, _ = post_due(store.read(taken), decisions, as_of)
        stores.append_rows(posted, ledger, f"due-{run}", run=(f"due {run}", taken))
    advance_stored(spark, schedules, decisions, as_of, run, taken)


def advance_stored(spark: SparkSession, schedules: str, decisions: DataFrame, as_of: dt.date, run: str, taken: int) -> None:
    """The second half: the dates that follow from version `taken` and the decisions are put into the newest version."""
    store = schedules_at(spark, schedules)
    moved = reschedule(post_due(store.read(taken), decisions, as_of)[1], decisions)
    ids = decisions.select(F.col("stid").alias("id")).distinct()
    dates = moved.join(ids, "id", "left_semi").select("id", F.struct("start_date", "last_approved").alias("__moved"))

    def put(rows: DataFrame) -> DataFrame:
        given = F.col("__moved").isNotNull()
        return rows.join(dates, "id", "left").withColumns({
            c: F.when(given, F.col(f"__moved.{c}")).otherwise(F.col(c)) for c in ("start_date", "last_approved")}).drop("__moved")

    store.change(ids, put, run)


def edit_schedules(spark: SparkSession, schedules: str, edits: DataFrame) -> None:
    """Schedule edits by (account_id, id) written back."""
    schedules_at(spark, schedules).change(edits.select("id"), lambda rows: apply_schedule_edits(rows, edits))


def edit_budgets(spark: SparkSession, budgets: str, edits: DataFrame) -> None:
    """Edited limits and flags written back; an edit of an unknown subject stores a new budget."""
    budgets_at(spark, budgets).change(edits.select("account_id", "subject"), lambda rows: upsert_budgets(rows, edits))


def refresh_stored(spark: SparkSession, budgets: str, ledger: str, sums: str, subject: str) -> None:
    """Stored budgets with last-month and average values of the ledger's newest version, from its kept sums; no old row is read."""
    kept.catch_up(spark, ledger, sums)
    rows = kept.as_rows(kept.read_cells(spark, sums))
    store = budgets_at(spark, budgets)
    store.change(store.read().select("account_id", "subject"), lambda held: refresh_budgets(held, rows, subject))
