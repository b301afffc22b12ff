"""Stores with one row per key, and the steps over schedules, budgets and a ledger."""

from __future__ import annotations

import datetime as dt
import hashlib
import pathlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.schema import BUDGETS, SCHEDULES
from ledgerloom.sources import keyed, kept, promotion, stores, versions

AS_OF = dt.date(2001, 7, 15)


def budget(account, subject, limit=1, **more):
    row = {"account_id": account, "subject": subject, "limit_amount": Decimal(limit), "last_month": Decimal(0), "avg_month": 0.0, "unit": "EUR", "apply": True, **more}
    return tuple(row[f] for f in BUDGETS.fieldNames())


def schedule(key, **more):
    row = {"id": key, "account_id": 1, "frequency": "Monthly", "interval_n": 1, "day": 5, "start_date": dt.date(2001, 1, 1),
           "end_date": dt.date(2005, 1, 1), "active": True, "last_approved": None, "amount": Decimal(-key), "description": "d", "type": "t",
           "category": "c", "subcategory": "s", "tag": "g", "payee": "p", **more}
    return tuple(row[f] for f in SCHEDULES.fieldNames())


@pytest.fixture
def budgets(spark, tmp_path):
    store = keyed.budgets_at(spark, str(tmp_path / "budgets"))
    store.create(spark.createDataFrame([budget(a, s) for a in range(5) for s in "xy"] + [budget(None, None)], BUDGETS), lots=7)
    return store


def limits(store, version=None):
    return {(r.account_id, r.subject): int(r.limit_amount) for r in store.read(version).collect()}


def hashes(store):
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(store.path).rglob("*.parquet")}


def test_upsert_replaces_adds_and_leaves_other_lots(spark, budgets):
    before, files, lots = limits(budgets), hashes(budgets), len(budgets.version().folders)
    replaced = budgets.upsert(spark.createDataFrame([budget(3, "x", 9), budget(None, None, 8), budget(3, None, 7)], BUDGETS))
    assert limits(budgets) == before | {(3, "x"): 9, (None, None): 8, (3, None): 7}
    assert len(replaced) <= 3 < lots
    assert files.items() <= hashes(budgets).items()
    # The version before stays readable.
    assert limits(budgets, 1) == before


def test_delete(spark, budgets):
    budgets.delete(spark.createDataFrame([(3, "x"), (None, None), (77, "x")], "account_id long, subject string"))
    assert (3, "x") not in limits(budgets) and (None, None) not in limits(budgets) and len(limits(budgets)) == 9
    budgets.delete(budgets.read())
    assert limits(budgets) == {}
    budgets.upsert(spark.createDataFrame([budget(1, "z")], BUDGETS))
    assert limits(budgets) == {(1, "z"): 1}


def test_a_key_is_stored_once(spark, budgets, tmp_path):
    twice = spark.createDataFrame([budget(1, "x", 2), budget(1, "x", 3)], BUDGETS)
    with pytest.raises(keyed.KeysTwice):
        budgets.upsert(twice)
    with pytest.raises(keyed.KeysTwice):
        keyed.budgets_at(spark, str(tmp_path / "other")).create(twice)
    with pytest.raises(versions.StoreChanged):
        budgets.create(twice.limit(1))
    with pytest.raises(FileNotFoundError):
        keyed.budgets_at(spark, str(tmp_path / "other")).read()
    assert not (tmp_path / "other").exists()


def test_a_run_is_done_once(spark, budgets):
    budgets.upsert(spark.createDataFrame([budget(1, "x", 5)], BUDGETS), run="r")
    assert budgets.upsert(spark.createDataFrame([budget(1, "x", 6)], BUDGETS), run="r") == []
    assert limits(budgets)[1, "x"] == 5
    # Also one that touches no row.
    budgets.upsert(budgets.read().limit(0), run="empty")
    at = versions.numbers(spark, budgets.path)
    budgets.upsert(budgets.read().limit(0), run="empty")
    budgets.upsert(budgets.read().limit(0))
    assert versions.numbers(spark, budgets.path) == at


def test_two_writers(spark, budgets):
    def meanwhile(rows):
        budgets.upsert(spark.createDataFrame([budget(1, "x", 5)], BUDGETS))
        return rows

    with pytest.raises(versions.StoreChanged):
        budgets.change(spark.createDataFrame([(1, "x")], "account_id long, subject string"), meanwhile)
    assert limits(budgets)[1, "x"] == 5


def test_an_empty_table_and_extra_columns(spark, tmp_path):
    store = keyed.budgets_at(spark, str(tmp_path / "empty"))
    store.create(spark.createDataFrame([], BUDGETS))
    assert limits(store) == {}
    store.upsert(spark.createDataFrame([budget(1, "x")], BUDGETS).withColumns({"lot": F.lit("q"), "year": F.lit(1), "extra": F.lit(2)}))
    assert limits(store) == {(1, "x"): 1} and store.read().columns == BUDGETS.fieldNames()


@pytest.fixture
def due(spark, tmp_path):
    """Three schedules due on 5 January 2001: one approved, one approved for another date, one moved."""
    path, ledger = str(tmp_path / "schedules"), str(tmp_path / "ledger")
    keyed.schedules_at(spark, path).create(spark.createDataFrame([schedule(k) for k in (1, 2, 3, 4)], SCHEDULES), lots=3)
    decisions = spark.createDataFrame([(1, True, None), (2, True, dt.date(2001, 1, 9)), (3, False, dt.date(2001, 2, 2))],
                                      "stid long, approve boolean, date date")
    return path, ledger, decisions


MOVED = {1: (dt.date(2001, 1, 6), AS_OF), 2: (dt.date(2001, 1, 10), AS_OF), 3: (dt.date(2001, 2, 2), None), 4: (dt.date(2001, 1, 1), None)}


def starts(spark, path):
    return {r.id: (r.start_date, r.last_approved) for r in keyed.schedules_at(spark, path).read().collect()}


def posted(spark, ledger):
    return sorted((int(r.amount), r.date, r.status) for r in stores.read_ledger(spark, ledger).collect())


POSTED = [(-2, dt.date(2001, 1, 9), True), (-1, dt.date(2001, 1, 5), True)]


def test_due_payments_are_posted_and_moved(spark, due):
    path, ledger, decisions = due
    for _ in range(2):
        promotion.post_due_store(spark, path, ledger, decisions, AS_OF, "r")
        assert starts(spark, path) == MOVED and posted(spark, ledger) == POSTED
    # The next run finds them due in February.
    promotion.post_due_store(spark, path, ledger, spark.createDataFrame([(1, True, None)], "stid long, approve boolean, date date"), AS_OF, "s")
    assert posted(spark, ledger) == sorted([*POSTED, (-1, dt.date(2001, 2, 5), True)])


def test_a_step_that_broke_off_between_its_stores(spark, due, monkeypatch):
    path, ledger, decisions = due

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(promotion, "advance_stored", fail)
        with pytest.raises(OSError):
            promotion.post_due_store(spark, path, ledger, decisions, AS_OF, "r")
    assert posted(spark, ledger) == POSTED and starts(spark, path)[1] == (dt.date(2001, 1, 1), None)
    # Edited in the meantime: the edit stays, nothing is posted again, the dates are those that follow from what was posted.
    edits = spark.createDataFrame([schedule(1, day=20, payee="edited")], SCHEDULES)
    promotion.edit_schedules(spark, path, edits)
    promotion.post_due_store(spark, path, ledger, decisions, AS_OF, "r")
    assert posted(spark, ledger) == POSTED and starts(spark, path) == MOVED
    assert {(r.day, r.payee) for r in keyed.schedules_at(spark, path).read().where("id = 1").collect()} == {(20, "edited")}


def test_budgets_are_edited_and_refreshed(spark, budgets, tmp_path, ledger):
    path, sums = str(tmp_path / "ledger"), str(tmp_path / "sums")
    edits = spark.createDataFrame([(1, "x", Decimal(50), "EUR", False), (9, "new", Decimal(60), "EUR", True)],
                                  "account_id long, subject string, limit_amount decimal(18,2), unit string, apply boolean")
    promotion.edit_budgets(spark, budgets.path, edits)
    assert limits(budgets)[1, "x"] == 50 and limits(budgets)[9, "new"] == 60
    stores.append_rows(ledger({"category": "x", "amount": -4}, {"category": "x", "amount": -2, "date": dt.date(2001, 6, 1)}), path)
    promotion.refresh_stored(spark, budgets.path, path, sums, "category")
    found = {(r.account_id, r.subject): (r.last_month, r.avg_month) for r in budgets.read().collect()}
    assert found[1, "x"] == (Decimal(-4), -3.0) and found[2, "x"] == (Decimal(0), 0.0)
    # A deletion reaches the budgets through the sums.
    stores.remove_rows(spark, path, stores.read_ledger(spark, path).where("amount = -2"))
    promotion.refresh_stored(spark, budgets.path, path, sums, "category")
    assert {(r.last_month, r.avg_month) for r in budgets.read().where("account_id = 1 and subject = 'x'").collect()} == {(Decimal(-4), -4.0)}
    assert kept.stands_for(spark, sums) == 2
