"""Sums of a ledger, kept up to date: equal to sums made anew after any change, and what a change or a read opens."""

from __future__ import annotations

import datetime as dt
import pathlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import balances, budgets, filters, shares
from ledgerloom.sources import kept, stores, versions


def bag(frame):
    return sorted(map(str, frame.collect()))


@pytest.fixture
def paths(tmp_path):
    return str(tmp_path / "ledger"), str(tmp_path / "sums")


def month_rows(ledger, account, *cells):
    return ledger(*[{"account_id": account, "date": dt.date(y, m, d), "amount": a, "status": s, **more} for y, m, d, a, s, more in cells])


@pytest.fixture
def batches(ledger):
    """Both signs, rows still open, without status, date, amount or subjects, and repeated rows."""
    return [
        month_rows(ledger, 1, (2018, 1, 1, 5, True, {}), (2018, 1, 9, -3, True, {}), (2018, 1, 9, -3, True, {}), (2018, 2, 1, 7, False, {}),
                   (2018, 2, 2, None, True, {}), (2018, 3, 3, 0, True, {"tag": None})),
        month_rows(ledger, 2, (2018, 1, 1, 5, None, {}), (2019, 1, 9, -4, True, {"category": None}), (2019, 1, 9, 8, True, {"date": None})),
        month_rows(ledger, 1, (2017, 5, 5, 100, True, {}), (2019, 5, 5, -1, True, {"tag": "Superfuture"}), (2019, 5, 6, 20, True, {"category": "x"})),
    ]


def check(spark, ledger, sums):
    kept.catch_up(spark, ledger, sums)
    rows = stores.read_ledger(spark, ledger)
    assert bag(kept.read_cells(spark, sums)) == bag(kept.cells_of(rows))


def edit(spark, ledger, condition, **changes):
    rows = stores.read_ledger(spark, ledger).where(condition).withColumns({"seq": F.lit(1), **changes})
    stores.edit_ledger(spark, ledger, rows)


def test_every_kind_of_change(spark, paths, batches):
    ledger, sums = paths
    for k, batch in enumerate(batches):
        stores.append_rows(batch, ledger, f"b{k}")
        check(spark, ledger, sums)
    stores.append_rows(batches[0].limit(2), ledger, "b0")
    check(spark, ledger, sums)
    edit(spark, ledger, "account_id = 1 and amount > 0", amount=F.col("amount") * 2, date=F.add_months("date", 3))
    check(spark, ledger, sums)
    stores.remove_rows(spark, ledger, stores.read_ledger(spark, ledger).where("account_id = 2"))
    check(spark, ledger, sums)
    assert [r.account_id for r in kept.read_cells(spark, sums).select("account_id").distinct().collect()] == [1]
    stores.remove_rows(spark, ledger, stores.read_ledger(spark, ledger))
    check(spark, ledger, sums)
    assert kept.read_cells(spark, sums).collect() == []


def test_changes_that_were_not_caught_up_one_by_one(spark, paths, batches):
    ledger, sums = paths
    stores.append_rows(batches[0], ledger, "b0")
    check(spark, ledger, sums)
    for k, batch in enumerate(batches):
        stores.append_rows(batch, ledger, f"b{k}")
    edit(spark, ledger, "account_id = 2", amount=F.lit(1).cast("decimal(18,2)"))
    check(spark, ledger, sums)


def test_no_folder_that_stayed_is_opened(spark, paths, batches):
    ledger, sums = paths
    stores.append_rows(batches[0], ledger, "b0")
    stores.append_rows(batches[1], ledger, "b1")
    kept.catch_up(spark, ledger, sums)
    expected = kept.cells_of(batches[0].unionByName(batches[1]).unionByName(batches[2]))
    expected = bag(expected)
    for p in pathlib.Path(ledger).rglob("*.parquet"):
        p.write_bytes(b"unreadable")
    stores.append_rows(batches[2], ledger, "b2")
    kept.catch_up(spark, ledger, sums)
    assert bag(kept.read_cells(spark, sums)) == expected


def test_nothing_is_done_twice(spark, paths, batches, monkeypatch):
    ledger, sums = paths
    stores.append_rows(batches[0], ledger, "b0")
    first = kept.catch_up(spark, ledger, sums)
    assert kept.catch_up(spark, ledger, sums) == first
    stores.append_rows(batches[1], ledger, "b1")

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "publish", fail)
        with pytest.raises(OSError):
            kept.catch_up(spark, ledger, sums)
    assert kept.stands_for(spark, sums) == 1
    check(spark, ledger, sums)
    # A second run that began from the same version is refused.
    with pytest.raises(versions.StoreChanged):
        versions.publish(spark, sums, first)


def test_a_version_that_is_gone(spark, paths, batches):
    ledger, sums = paths
    for k, batch in enumerate(batches):
        stores.append_rows(batch, ledger, f"b{k}")
        if k == 0:
            kept.catch_up(spark, ledger, sums)
    stores.append_rows(batches[0].limit(1), ledger, "b0")
    stores.remove_unused(spark, ledger, keep=1)
    check(spark, ledger, sums)


def test_differences_become_a_base(spark, paths, ledger):
    path, sums = paths
    stores.append_rows(ledger(*[{"date": dt.date(2018, m, 1)} for m in range(1, 9)]), path)
    kept.catch_up(spark, path, sums)
    for m in range(1, 9):
        stores.append_rows(ledger({"date": dt.date(2019, m, 1)}), path)
        kept.catch_up(spark, path, sums)
    assert [(f.lot, f.rows) for f in versions.read(spark, sums).folders] == [("base", 8)] + [("difference", 1)] * 8
    stores.append_rows(ledger({"date": dt.date(2020, 1, 1)}), path)
    check(spark, path, sums)
    assert [(f.lot, f.rows) for f in versions.read(spark, sums).folders] == [("base", 17)]


def test_an_empty_ledger_and_none(spark, paths, ledger):
    path, sums = paths
    for missing in (lambda: kept.catch_up(spark, path, sums), lambda: kept.read_cells(spark, sums), lambda: kept.stands_for(spark, sums)):
        with pytest.raises(FileNotFoundError):
            missing()
    stores.append_rows(ledger({}).limit(0), path)
    check(spark, path, sums)
    stores.append_rows(ledger({"account_id": 4}), path)
    check(spark, path, sums)


def test_sums_as_rows_give_the_same_answers(spark, paths, batches):
    path, sums = paths
    rows = batches[0].unionByName(batches[1]).unionByName(batches[2]).where("amount is not null")
    stores.append_rows(rows, path)
    kept.catch_up(spark, path, sums)
    done, again = filters.completed(stores.read_ledger(spark, path)), kept.as_rows(kept.read_cells(spark, sums))
    openings = spark.createDataFrame([(1, Decimal(10)), (3, Decimal(1))], "account_id long, opening decimal(18,2)")
    accounts = spark.createDataFrame([(1, "a", Decimal(10), "EUR"), (2, "b", None, None), (3, "c", Decimal(1), "x")],
                                     "account_id long, name string, balance decimal(18,2), currency string")
    for f in (lambda r: shares.spend_by_period(r, "tag", "year"), lambda r: shares.spend_by_period(r, "category", "month", 12),
              lambda r: shares.spend_by_period(filters.outgo(r), "subcategory"),
              lambda r: shares.percent_of_income(shares.spend_by_period(r, "category")),
              budgets.average_monthly_income, lambda r: budgets.last_month(r, "category"), lambda r: budgets.average_month(r, "tag"),
              lambda r: balances.closing_by_year(r, openings), lambda r: balances.closing_by_month(r, openings, 12)):
        assert bag(f(again)) == bag(f(done)) != []
    assert bag(kept.account_overview(accounts, kept.read_cells(spark, sums))) == bag(balances.account_overview(accounts, stores.read_ledger(spark, path)))
    assert bag(kept.read_cells(spark, sums, account=2)) == bag(kept.read_cells(spark, sums).where("account_id = 2"))
    assert kept.read_cells(spark, sums, account=9).collect() == []


@pytest.mark.parametrize("first", [dt.date(2018, 1, 1), dt.date(2018, 1, 9), dt.date(2019, 5, 6), dt.date(2030, 1, 1)])
def test_balances_since(spark, paths, batches, first):
    path, sums = paths
    for batch in batches:
        stores.append_rows(batch, path)
    kept.catch_up(spark, path, sums)
    openings = spark.createDataFrame([(1, Decimal(10))], "account_id long, opening decimal(18,2)")
    whole = balances.running_balance(filters.completed(stores.read_ledger(spark, path)), openings).where(F.col("date") >= F.lit(first))
    expected, one = bag(whole), bag(whole.where("account_id = 1"))
    # Folders of earlier years are not opened.
    for p in pathlib.Path(path).rglob("*.parquet"):
        year = next(x for x in p.parts if x.startswith("year="))[5:]
        if not year.isdigit() or int(year) < first.year:
            p.write_bytes(b"unreadable")
    assert bag(kept.running_balance_since(spark, path, sums, openings, first)) == expected
    assert bag(kept.running_balance_since(spark, path, sums, openings, first, account=1)) == one


def test_rows_dated_back_count_once_caught_up(spark, paths, ledger):
    path, sums = paths
    stores.append_rows(ledger({"date": dt.date(2019, 3, 3), "amount": 1}), path)
    kept.catch_up(spark, path, sums)
    openings = spark.createDataFrame([], "account_id long, opening decimal(18,2)")
    stores.append_rows(ledger({"date": dt.date(2018, 3, 3), "amount": 50}), path)
    with pytest.raises(kept.LedgerBehind):
        kept.running_balance_since(spark, path, sums, openings, dt.date(2019, 1, 1))
    kept.catch_up(spark, path, sums)
    assert [r.closing_balance for r in kept.running_balance_since(spark, path, sums, openings, dt.date(2019, 1, 1)).collect()] == [Decimal(51)]


def test_an_edit_is_added_up_in_one_aggregate(spark, paths, batches, monkeypatch):
    """Rows that went and rows that came meet in one aggregate, and a side without rows is not read."""
    ledger, sums = paths
    written, write = [], kept._write
    monkeypatch.setattr(kept, "_write", lambda cells, *more: written.append(cells) or write(cells, *more))
    stores.append_rows(batches[0], ledger, "b0")
    check(spark, ledger, sums)
    edit(spark, ledger, "amount > 0", amount=F.lit(9))
    check(spark, ledger, sums)
    plans = [c._jdf.queryExecution().optimizedPlan().toString() for c in written]
    assert [p.count("Aggregate [") for p in plans[:2]] == [1, 1]
    assert "Union" not in plans[0] and "Union" in plans[1]
    assert not any("LogicalRDD" in p for p in plans)
