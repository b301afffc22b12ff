"""Stores: replaced batches, edits, deletions, promotion, writers at the same time, and what a change or a read opens."""

from __future__ import annotations

import datetime as dt
import hashlib
import pathlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.schema import STAGING
from ledgerloom.sources import promotion, stores, versions

AS_OF = dt.date(2001, 7, 15)


def files(path):
    """Every data file of a store by what it holds."""
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in pathlib.Path(path).rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path, ledger):
    """Three batches of one account each, in 2018 and 2019; ids 0 and 1, 2 and 3, 4 and 5."""
    path = str(tmp_path / "store")
    for account in (1, 2, 3):
        stores.append_rows(ledger(*[{"account_id": account, "date": dt.date(y, 1, 1), "tag": f"{account}-{y}"} for y in (2018, 2019)]), path, f"b{account}")
    return path


def told(spark, path):
    return sorted((r.tid, r.account_id, r.date.year, r.tag) for r in stores.read_ledger(spark, path).collect())


def test_a_batch_is_replaced_in_all_its_years(spark, store, ledger):
    stores.append_rows(ledger({"account_id": 3, "date": dt.date(2019, 5, 5), "tag": "new"}), store, "b3")
    assert told(spark, store) == [(0, 1, 2018, "1-2018"), (1, 1, 2019, "1-2019"), (2, 2, 2018, "2-2018"), (3, 2, 2019, "2-2019"), (4, 3, 2019, "new")]
    # An older batch gets new ids: those after its own are taken.
    stores.append_rows(ledger({"account_id": 1, "date": dt.date(2019, 5, 5), "tag": "again"}), store, "b1")
    assert told(spark, store) == [(2, 2, 2018, "2-2018"), (3, 2, 2019, "2-2019"), (4, 3, 2019, "new"), (5, 1, 2019, "again")]
    stores.append_rows(stores.read_ledger(spark, store).limit(0), store, "b1")
    assert [r[1] for r in told(spark, store)] == [2, 2, 3]


def test_ids_of_deleted_rows_are_not_given_again(spark, store, ledger):
    stores.remove_rows(spark, store, spark.createDataFrame([(5,), (99,)], "tid long"))
    stores.append_rows(ledger({"tag": "later"}), store)
    assert [r[0] for r in told(spark, store)] == [0, 1, 2, 3, 4, 6]


def test_an_append_reads_no_stored_row(spark, store, ledger):
    for p in pathlib.Path(store).rglob("*.parquet"):
        p.write_bytes(b"unreadable")
    assert stores.append_rows(ledger({"tag": "later"}), store).folders[-1].first_id == 6


def test_a_read_creates_nothing(spark, tmp_path):
    for read in (stores.read_ledger, stores.open_store, stores.read_staging):
        with pytest.raises(FileNotFoundError):
            read(spark, str(tmp_path / "mistyped"))
    assert stores.open_store(spark, str(tmp_path / "mistyped"), missing_ok=True).collect() == []
    assert not (tmp_path / "mistyped").exists()


def edit(spark, tid, account, **new):
    row = {"account_id": account, "tid": tid, "seq": 1, "date": dt.date(2019, 2, 2), "amount": Decimal(5), "type": "Cash", "description": "e",
           "category": "c", "subcategory": "s", "tag": "  edited", "status": True, "payee": "p", **new}
    return spark.createDataFrame([row], "account_id long, tid long, seq int, date date, amount decimal(18,2), type string, description string, "
                                 "category string, subcategory string, tag string, status boolean, payee string")


def test_an_edit_rewrites_the_folders_it_touches(spark, store):
    before = files(store)
    touched = stores.edit_ledger(spark, store, edit(spark, 2, 2))
    assert [(f.batch, f.year) for f in touched] == [("b2", 2018)]
    # The edited row moved to its new year and kept its id and batch.
    assert told(spark, store)[2] == (2, 2, 2019, "edited")
    assert {r.batch for r in stores.open_store(spark, store).where("tid = 2").collect()} == {"b2"}
    after = files(store)
    assert {p: h for p, h in after.items() if p in before} == before and len(after) == len(before) + 1
    # Replacing the batch takes the edited row away with the rest.
    stores.append_rows(stores.read_ledger(spark, store).limit(0), store, "b2")
    assert [r[0] for r in told(spark, store)] == [0, 1, 4, 5]


def test_a_change_that_touches_nothing_makes_no_version(spark, store):
    newest = versions.numbers(spark, store)[-1]
    assert stores.remove_rows(spark, store, spark.createDataFrame([(77,), (None,)], "tid long")) == []
    # The id is there, the account is another's: the row stays as it is.
    stores.edit_ledger(spark, store, edit(spark, 2, 9))
    assert told(spark, store)[2] == (2, 2, 2018, "2-2018")
    assert versions.numbers(spark, store)[-1] <= newest + 1


def test_slices_bound_what_an_edit_rewrites(spark, tmp_path, ledger, monkeypatch):
    monkeypatch.setattr(stores, "SLICE_ROWS", 4)
    path = str(tmp_path / "sliced")
    stores.append_rows(ledger(*[{"account_id": i % 5, "tag": str(i)} for i in range(20)]), path)
    folders = versions.read(spark, path).folders
    assert sorted((f.first_id, f.last_id, f.rows) for f in folders) == [(4 * k, 4 * k + 3, 4) for k in range(5)]
    # Ids follow the accounts, so a slice holds one account here.
    assert all(f.first_account == f.last_account for f in folders)
    assert len(stores.remove_rows(spark, path, spark.createDataFrame([(6,), (7,)], "tid long"))) == 1
    assert stores.read_ledger(spark, path).count() == 18


def test_two_writers(spark, store, ledger):
    held = versions.read(spark, store)
    stores.append_rows(ledger({"tag": "first"}), store)
    with pytest.raises(versions.StoreChanged):
        versions.publish(spark, store, held)
    assert len(told(spark, store)) == 7
    # Even if both have looked before either published.
    known, versions.numbers = versions.numbers, lambda *_: []
    try:
        with pytest.raises(versions.StoreChanged):
            versions.publish(spark, store, held)
    finally:
        versions.numbers = known
    assert len(told(spark, store)) == 7 and all("." not in p.name[0] for p in pathlib.Path(store, "_versions").glob("*.json"))


def test_a_writer_that_breaks_off_is_not_seen(spark, store, ledger, monkeypatch):
    def fail(*_):
        raise OSError("lost")

    before = told(spark, store)
    with monkeypatch.context() as m:
        m.setattr(versions, "publish", fail)
        with pytest.raises(OSError):
            stores.append_rows(ledger({"tag": "lost"}), store)
    assert told(spark, store) == before
    assert len(stores.remove_unused(spark, store)) == 1 and told(spark, store) == before
    assert stores.remove_unused(spark, store) == []


def test_earlier_versions(spark, store):
    first = versions.numbers(spark, store)[0]
    assert stores.read_ledger(spark, store, version=first).count() == 2
    stores.remove_rows(spark, store, spark.createDataFrame([(0,), (1,)], "tid long"))
    assert stores.read_ledger(spark, store, version=first).count() == 2
    assert len(stores.remove_unused(spark, store, keep=1)) == 2  # the deleted rows' commit, and the one without rows
    with pytest.raises(FileNotFoundError):
        stores.read_ledger(spark, store, version=first)
    assert [r[0] for r in told(spark, store)] == [2, 3, 4, 5]


def test_reads_of_one_account_or_span_open_its_folders(spark, store):
    assert len(stores.read_ledger(spark, store).inputFiles()) == 6
    assert len(stores.read_ledger(spark, store, account=2).inputFiles()) == 2
    assert len(stores.read_ledger(spark, store, dt.date(2019, 1, 1), account=2).inputFiles()) == 1
    assert stores.read_ledger(spark, store, dt.date(2019, 1, 2), account=2).inputFiles() == []
    assert {r.account_id for r in stores.read_ledger(spark, store, account=2).collect()} == {2}


@pytest.fixture
def staged(spark, tmp_path):
    path = str(tmp_path / "staged")

    def add(*rows):
        full = [(i, a, AS_OF, Decimal(m), "Cash", "d", "b") for i, (a, m) in enumerate(rows)]
        stores.append_rows(spark.createDataFrame(full, STAGING), path, schema=STAGING)
        return path

    return add


def amounts(spark, ledger, staging):
    return (sorted((r.account_id, int(r.amount)) for r in stores.read_ledger(spark, ledger).collect()),
            sorted((r.account_id, int(r.amount)) for r in stores.read_staging(spark, staging).collect()))


def test_promotion(spark, tmp_path, staged):
    path, target = staged((1, 1), (1, 1), (1, 2), (2, 5)), str(tmp_path / "ledger")
    one = spark.createDataFrame([(1,)], "account_id long")
    assert promotion.promote_store(spark, path, target, AS_OF, "r1", one) == 3
    expected = ([(1, 1), (1, 2)], [(2, 5)])
    assert amounts(spark, target, path) == expected
    at = versions.numbers(spark, path), versions.numbers(spark, target)
    assert promotion.promote_store(spark, path, target, AS_OF, "r1", one) == 0
    assert amounts(spark, target, path) == expected and at == (versions.numbers(spark, path), versions.numbers(spark, target))
    assert promotion.promote_store(spark, path, target, AS_OF, "r2") == 1
    assert amounts(spark, target, path) == ([(1, 1), (1, 2), (2, 5)], [])


def test_promotion_that_broke_off_between_its_stores(spark, tmp_path, staged, monkeypatch):
    path, target = staged((1, 1), (2, 5)), str(tmp_path / "ledger")

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(promotion, "leave_staging", fail)
        with pytest.raises(OSError):
            promotion.promote_store(spark, path, target, AS_OF, "r")
    assert amounts(spark, target, path) == ([(1, 1), (2, 5)], [(1, 1), (2, 5)])
    staged((1, 9))  # staged in the meantime: not part of the run
    assert promotion.promote_store(spark, path, target, AS_OF, "r") == 2
    assert amounts(spark, target, path) == ([(1, 1), (2, 5)], [(1, 9)])


def test_rows_without_a_date_or_amount(spark, tmp_path, ledger):
    path = str(tmp_path / "odd")
    stores.append_rows(ledger({"date": None, "amount": None, "tag": None}, {"tag": "x"}), path)
    assert {f.year for f in versions.read(spark, path).folders} == {None, 2001}
    (row,) = stores.read_ledger(spark, path).where(F.col("date").isNull()).collect()
    stores.remove_rows(spark, path, spark.createDataFrame([(row.tid,)], "tid long"))
    assert [r.tag for r in stores.read_ledger(spark, path).collect()] == ["x"]
    assert stores.read_ledger(spark, path, dt.date(2001, 1, 1)).count() == 1


def test_no_rows_start_no_task(spark, tmp_path):
    """A store that is not there yet is no rows to the planner, not a job that finds none."""
    none = stores.open_store(spark, str(tmp_path / "none"), missing_ok=True)
    assert none._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation")
    assert [(f.name, f.dataType) for f in none.schema][:-2] == [(f.name, f.dataType) for f in stores.LEDGER]


def test_edits_are_worked_out_once(spark, store, monkeypatch):
    """Edits read from the store are written aside once; finding the folders and changing the rows read these."""
    given, change = [], stores.change_rows
    monkeypatch.setattr(stores, "change_rows", lambda spark, path, ids, *more: given.append(ids) or change(spark, path, ids, *more))
    edits = stores.read_ledger(spark, store).where("tid = 1").withColumns({"seq": F.lit(1), "tag": F.lit("new")})
    stores.edit_ledger(spark, store, edits)
    assert store not in str(given[0].inputFiles()) and [t[3] for t in told(spark, store)].count("new") == 1


def test_rows_staged_twice_are_worked_out_once(spark, ledger, monkeypatch):
    from ledgerloom.catalog import inputs

    rows = ledger({}, {"account_id": 2})
    monkeypatch.setattr(inputs, "staging", lambda *_: rows.select("tid", "account_id").join(rows.select("tid", "amount").hint("merge"), "tid"))
    twice = inputs.staged_twice(spark, "", AS_OF)
    assert "Join" not in twice._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.tid for r in twice.collect()) == [0, 1, 2, 3]
