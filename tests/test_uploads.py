"""Upload files of all three kinds, and the incremental ingest."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import balances, cleaning
from ledgerloom.sources import stores, uploads
from ledgerloom.streaming.incremental import ingest_new_files, stored_rows

HEADER = "Booking date;Value date;Transaction Type;Beneficiary / Originator;Payment Details;IBAN;Debit;Credit;Currency"


def statement(lines, preamble=4):
    return "".join(f"line {i};;\n" for i in range(preamble)) + HEADER + "\n" + "\n".join(lines) + "\n"


def test_extensions(spark):
    names = ["a.json", "b.CSV", "c.tar.dbcsv", "d.txt", "json", "e.csv.exe"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    found = rows.select(uploads.extension(F.col("name")).alias("e"), uploads.accepted_file(F.col("name")).alias("ok"))
    assert [(r.e, r.ok) for r in found.collect()] == [
        ("json", True), ("csv", True), ("dbcsv", True), ("txt", False), ("", False), ("exe", False)]


def test_each_reader_takes_its_own_files(spark, tmp_path):
    record = {"tid": 4, "date": "2001-02-03T00:00:00.000Z", "amount": 1.5, "closing_balance": 3}
    (tmp_path / "a.JSON").write_text(json.dumps([record, {**record, "date": "2001-02-04"}]))
    (tmp_path / "b.csv").write_text("date;paymode;info;payee;wording;amount;category;tags\n03/02/2001;8;;;w;-2.5;Food;t\n")
    (tmp_path / "c.dbcsv").write_text(statement(["x;02/03/2001;Cash;me;why;;-1,000.00;;EUR"]))
    raw = uploads.read_json_records(spark, str(tmp_path)).withColumn("account_id", F.lit(1))
    rows = cleaning.json_rows(raw).orderBy("date").collect()
    assert [(r.date, r.amount) for r in rows] == [
        (dt.date(2001, 2, 3), Decimal("1.50")), (dt.date(2001, 2, 4), Decimal("1.50"))]
    assert not {"tid", "closing_balance"} & set(rows[0].asDict())
    row = cleaning.homebank_rows(uploads.read_homebank(spark, str(tmp_path)).withColumn("account_id", F.lit(1))).first()
    assert (row.date, row.type, row.payee, row.category, row.subcategory, row.amount) == (
        dt.date(2001, 2, 3), "Electronic payment", "not provided", "Leisure", "Dining Out", Decimal("-2.50"))
    row = cleaning.statement_rows(uploads.read_statement(spark, str(tmp_path)).withColumn("account_id", F.lit(1))).first()
    assert (row.date, row.type, row.beneficiary, row.description, row.amount) == (
        dt.date(2001, 2, 3), "Cash", "me", "why", -1000)


def test_unreadable_values_do_not_stop_an_upload(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"date": "soon", "amount": 1}]))
    (tmp_path / "b.csv").write_text("date;paymode;info;payee;wording;amount;category;tags\n31/02/2001;x;;;w;much;;\n")
    row = cleaning.json_rows(uploads.read_json_records(spark, str(tmp_path))).first()
    assert (row.date, row.amount) == (None, 1)
    row = cleaning.homebank_rows(uploads.read_homebank(spark, str(tmp_path)).withColumn("account_id", F.lit(1))).first()
    assert (row.date, row.amount, row.type, row.category) == (None, None, None, "not provided")


def test_a_file_that_is_not_json_stops_the_read(spark, tmp_path):
    (tmp_path / "a.json").write_text("not json")
    with pytest.raises(Exception, match="FAILFAST|MALFORMED"):
        uploads.read_json_records(spark, str(tmp_path)).collect()


def test_statement_charset_columns_and_short_lines(spark, tmp_path):
    text = statement(["x;02/03/2001;Cash;Jürgen;\"a;why", "", "only;02/04/2001"])
    (tmp_path / "a.dbcsv").write_bytes(text.encode("latin-1"))
    moved = statement([]).replace("Value date;Transaction Type", "Transaction Type;Value date") + "x;Fee;02/05/2001;b;c;;1;2;EUR\n"
    (tmp_path / "b.dbcsv").write_text(moved)
    rows = uploads.read_statement(spark, str(tmp_path), others={"IBAN": "iban"}).orderBy("value_date").collect()
    assert [(r.value_date, r.transaction_type, r.beneficiary, r.payment_details, r.iban) for r in rows] == [
        ("02/03/2001", "Cash", "Jürgen", '"a', "why"), ("02/04/2001", None, None, None, None),
        ("02/05/2001", "Fee", "b", "c", None)]


@pytest.mark.parametrize("hot", [10**6, 50])
def test_statement_split_over_tasks(spark, tmp_path, hot_rows, hot):
    hot_rows(hot)
    lines = [f"x;02/03/2001;Cash;me;{i};;-1;;EUR" for i in range(3000)]
    (tmp_path / "a.dbcsv").write_text(statement(lines))
    (tmp_path / "b.dbcsv").write_text(statement([lines[0]]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = uploads.read_statement(spark, str(tmp_path))
        found = rows.select("payment_details", "value_date", "debit").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.payment_details for r in found) == sorted(["0", *map(str, range(3000))])
    assert {(r.value_date, r.debit) for r in found} == {("02/03/2001", "-1")}


def test_export_and_read_back(spark, tmp_path, ledger):
    rows = ledger({"amount": "-1.50", "category": None}, {"payee": 'a "b"'})
    texts = [json.loads(r.record) for r in stores.json_records(rows).orderBy("tid").collect()]
    assert texts[0]["date"] == "2001-07-15T00:00:00.000Z" and texts[0]["category"] is None
    assert texts[0]["amount"] == -1.5 and texts[1]["payee"] == 'a "b"'
    stores.export_json(rows, str(tmp_path / "out"))
    raw = uploads.read_json_records(spark, str(tmp_path / "out"), lines=True)
    back = cleaning.json_rows(raw).select("date", "amount", "category", "payee").orderBy("amount").collect()
    assert [tuple(r) for r in back] == [
        (dt.date(2001, 7, 15), Decimal("-1.50"), None, "p"), (dt.date(2001, 7, 15), 0, "c", 'a "b"')]


def test_append(spark, tmp_path, ledger):
    path = str(tmp_path / "ledger")
    stores.append_rows(ledger({"date": dt.date(2000, 1, 1)}), path)
    stores.append_rows(ledger({"tid": 7}), path)
    assert sorted(r.tid for r in stores.read_ledger(spark, path).collect()) == [0, 1]
    late = stores.read_ledger(spark, path, dt.date(2001, 1, 1), dt.date(2001, 12, 31))
    assert [r.tid for r in late.collect()] == [1]
    assert len(late.inputFiles()) == 1  # the other year's folder is not even listed
    assert "PartitionFilters: [isnotnull(year" in late._jdf.queryExecution().executedPlan().toString()
    assert stores.ledger_rows(spark.read.parquet(path)).columns == stores.LEDGER.fieldNames()


@pytest.fixture
def arriving(tmp_path):
    def write(name, *rows, account=1):
        folder = tmp_path / "in" / f"account_id={account}"
        folder.mkdir(parents=True, exist_ok=True)
        head = "date;paymode;info;payee;wording;amount;category;tags"
        (folder / name).write_text("\n".join([head, *rows]) + "\n")

    return write


def test_ingest_adds_each_purchase_once(spark, tmp_path, arriving):
    paths = [str(tmp_path / p) for p in ("in", "ledger", "progress")]
    a, b, c = (f"0{i}/01/2001;8;;p;w;-{i};Food;t" for i in (1, 2, 3))
    arriving("one.csv", a, b, b)
    ingest_new_files(spark, *paths)
    assert stored_rows(spark, paths[1]).count() == 2
    ingest_new_files(spark, *paths)
    assert stored_rows(spark, paths[1]).count() == 2
    arriving("two.csv", b, c)
    arriving("one.csv", a, account=2)
    ingest_new_files(spark, *paths, files_per_batch=1)
    rows = stored_rows(spark, paths[1]).collect()
    assert sorted((r.account_id, r.amount) for r in rows) == [(1, -3), (1, -2), (1, -1), (2, -1)]
    assert {r.category for r in rows} == {"Leisure"}


def test_ingest_of_json_and_statements(spark, tmp_path):
    folder = tmp_path / "in" / "account_id=4"
    folder.mkdir(parents=True)
    ledger, staging = str(tmp_path / "ledger"), str(tmp_path / "staging")

    def ingest():
        for kind, store in (("json", ledger), ("dbcsv", staging)):
            ingest_new_files(spark, str(tmp_path / "in"), store, f"{store}-progress", kind=kind)
        return (sorted((r.account_id, r.amount) for r in stored_rows(spark, ledger, "json").collect()),
                sorted((r.account_id, r.amount, r.description) for r in stored_rows(spark, staging, "dbcsv").collect()))

    record = {"date": "2001-02-03T00:00:00.000Z", "amount": 1.5, "type": "Cash"}
    (folder / "a.json").write_text(json.dumps([record, record, {**record, "amount": 2}]))
    (folder / "a.dbcsv").write_text(statement(["x;02/03/2001;Cash;me;a;;-1;;EUR", "x;02/03/2001;Cash;me;b;;-2;;EUR"]))
    assert ingest() == ([(4, Decimal("1.50")), (4, 2)], [(4, -2, "b"), (4, -1, "a")])
    (folder / "b.json").write_text(json.dumps([record, {**record, "amount": 3}, {**record, "date": None}]))
    (folder / "b.dbcsv").write_text(statement(["x;02/03/2001;Cash;me;a;;-1;;EUR"]))
    rows, staged = ingest()
    assert rows == [(4, Decimal("1.50")), (4, Decimal("1.50")), (4, 2), (4, 3)]
    assert staged == [(4, -2, "b"), (4, -1, "a"), (4, -1, "a")]
    (folder / "c.json").write_text(json.dumps([{**record, "date": None}]))
    assert ingest()[0] == rows
    with pytest.raises(ValueError):
        ingest_new_files(spark, str(folder), ledger, ledger, kind="txt")


def test_a_repeated_batch_replaces_itself(spark, tmp_path, arriving):
    from ledgerloom.streaming import incremental

    path = str(tmp_path / "ledger")
    arriving("one.csv", "1/1/2001;8;;p;w;-1;Food;t")
    raw = uploads.read_homebank(spark, str(tmp_path / "in")).withColumn("account_id", F.lit(1).cast("long"))
    store = incremental._store(path, "csv", incremental._cleaner("csv", F.lit(1).cast("long")), "s")
    for _ in range(2):
        store(raw.drop("pos"), 0)
    assert [(r.tid, r.year, r.batch) for r in stored_rows(spark, path).collect()] == [(0, 2001, "s-0")]


def test_streamed_rows_are_a_ledger(spark, tmp_path, arriving):
    """What is ingested has ids, is found by bounds on its dates, takes appends and gives balances."""
    paths = [str(tmp_path / p) for p in ("in", "ledger", "progress")]
    arriving("one.csv", *[f"0{d}/01/200{d};8;;p;w{d};-{d};Food;t" for d in range(1, 6)])
    ingest_new_files(spark, *paths)
    stores.append_rows(stores.read_ledger(spark, paths[1]).withColumn("date", F.lit(dt.date(2009, 1, 1))), paths[1])
    rows = stores.read_ledger(spark, paths[1])
    assert sorted(r.tid for r in rows.collect()) == list(range(10))
    assert stores.read_ledger(spark, paths[1], dt.date(2002, 1, 1), dt.date(2004, 1, 31)).count() == 3
    closing = balances.running_balance(rows, spark.createDataFrame([(1, Decimal(100))], "account_id long, opening decimal(18,2)"))
    assert closing.agg(F.min("closing_balance")).first()[0] == 70
    stores.compact(spark, paths[1], str(tmp_path / "compacted"))
    assert sorted(stores.read_ledger(spark, str(tmp_path / "compacted")).collect()) == sorted(rows.collect())


def test_a_batch_reads_the_years_it_touches(spark, tmp_path, ledger):
    from ledgerloom.streaming import incremental

    path = str(tmp_path / "ledger")
    for year in (1999, 2000, 2001):
        stores.append_rows(ledger({"date": dt.date(year, 5, 5)}), path)
    earlier = incremental.earlier_rows(ledger({"date": dt.date(2000, 5, 5)}), stores.open_store(spark, path))
    assert [r.year for r in earlier.collect()] == [2000]
    plan = earlier._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan[plan.index("PartitionFilters"):].split("]")[0]


def test_rows_without_an_account_are_rejected(spark, tmp_path, ledger):
    rows = ledger({"account_id": None}, {"account_id": 1})
    path = str(tmp_path / "ledger")
    stores.append_rows(rows, path)
    assert [r.account_id for r in stores.read_ledger(spark, path).collect()] == [1]
    assert [(r.account_id, r.reason) for r in stores.rejected(rows).collect()] == [(None, "no account")]


def test_streamed_json_lines_and_written_dates(spark, tmp_path):
    folder = tmp_path / "in" / "account_id=4"
    folder.mkdir(parents=True)
    dates = ["2001-02-03T00:00:00.000Z", "981158400000", "2001-02-03", None, "soon"]
    (folder / "a.json").write_text("\n".join(json.dumps({"date": d, "amount": i}) for i, d in enumerate(dates)))
    paths = [str(tmp_path / p) for p in ("in", "ledger", "progress")]
    ingest_new_files(spark, *paths, kind="json", lines=True)
    found = {int(r.amount): r.date for r in stored_rows(spark, paths[1], "json").collect()}
    assert found == {0: dt.date(2001, 2, 3), 1: dt.date(2001, 2, 3), 2: dt.date(2001, 2, 3), 3: None, 4: None}
    raw = uploads.read_json_records(spark, paths[0], lines=True)
    assert [r.date for r in cleaning.unreadable_dates(raw, "date", cleaning.json_date).collect()] == ["soon"]


def test_dates_as_they_are_written(spark):
    texts = spark.createDataFrame([(t,) for t in ("5/1/2018", "05/01/2018", "2018-01-05", " ", None, "31/31/2018")], "t string")
    rows = texts.select(cleaning.homebank_date(F.col("t")).alias("a"), cleaning.statement_date(F.col("t")).alias("b")).collect()
    day, month = dt.date(2018, 1, 5), dt.date(2018, 5, 1)
    assert [tuple(r) for r in rows] == [(day, month), (day, month), (None, day), (None, None), (None, None), (None, None)]


def test_eight_digits_are_a_date_or_unreadable(spark):
    texts = spark.createDataFrame([(t,) for t in ("20180105", "20181305", "981158400000", "-98115840000")], "t string")
    found = [r.d for r in texts.select(cleaning.json_date(F.col("t")).alias("d")).collect()]
    assert found == [dt.date(2018, 1, 5), None, dt.date(2001, 2, 3), dt.date(1966, 11, 22)]
    assert [r.t for r in cleaning.unreadable_dates(texts, "t", cleaning.json_date).collect()] == ["20181305"]
