"""One account holding most rows: same results, small groups."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dedup, filters, shares
from ledgerloom.plans import skew


@pytest.fixture
def lopsided(ledger):
    """Account 1 has a third of the rows, many of them on one day."""
    rng = random.Random(5)
    first = dt.date(2000, 1, 1)
    return ledger(*[
        {"account_id": 1 if i % 3 == 0 else 2 + rng.randrange(50),
         "date": first if i % 2 else first + dt.timedelta(days=rng.randrange(40)),
         "amount": rng.randrange(-500, 500)} for i in range(600)])


def brute_force(rows, opening, newest_first):
    totals, found = {}, {}
    for r in sorted(rows, key=lambda r: (r.date, r.tid), reverse=newest_first):
        totals[r.account_id] = totals.get(r.account_id, opening.get(r.account_id, 0)) + r.amount
        found[r.tid] = totals[r.account_id]
    return found


@pytest.mark.parametrize("newest_first", [False, True])
@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_total(spark, monkeypatch, lopsided, openings, parts, newest_first):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    start = {1: Decimal(7), 3: Decimal(-2)}
    rows = skew.running_total(lopsided, openings(a1="7", a3="-2"), newest_first=newest_first)
    assert rows.columns == [*lopsided.columns, "closing_balance"]
    assert {r.tid: r.closing_balance for r in rows.collect()} == brute_force(
        lopsided.collect(), start, newest_first)
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_rows_without_ids_keep_their_place_and_start(spark, ledger, openings):
    rows = ledger(*[{"tid": None, "date": dt.date(2000, 1, d), "amount": 1} for d in range(1, 7)])
    closing = skew.running_total(rows, openings(a1="100")).orderBy("date").collect()
    assert [r.closing_balance for r in closing] == [101, 102, 103, 104, 105, 106]


def test_no_part_grows_with_one_account_or_one_day(spark, ledger, openings):
    """All rows in one account on one day, without ids: the parts of the running total stay even."""
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = ledger(*[{"tid": None, "amount": i, "description": f"d{i}"} for i in range(4000)])
    order = [F.col("account_id"), F.col("date"), F.col("tid"), F.xxhash64(*rows.columns)]
    sizes = [r["count"] for r in rows.repartitionByRange(*order).groupBy(F.spark_partition_id()).count().collect()]
    total = skew.running_total(rows, openings(a1="0")).agg(F.max("closing_balance")).first()[0]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 8 and max(sizes) < 1000
    assert total == sum(range(4000))


def test_rows_without_an_account_are_a_group(ledger):
    rows = ledger(*[{"account_id": None, "date": dt.date(2001, 7, d)} for d in range(1, 7)])
    assert filters.trailing_months(rows, 1).count() == 6
    assert filters.latest_rows(rows, dt.date(2001, 7, 5)).count() == 6


def test_the_columns_of_a_pivot_add_up(ledger):
    rows = ledger(*[{"category": c, "amount": i + 1} for i, c in enumerate(["a", "b", "ZZ", "ZZ"])])
    cells = shares.spend_by_period(rows, "category", "year")
    for wide in (shares.pivot(cells), shares.pivot(cells, ["a"])):
        row = wide.first().asDict()
        assert sum(v for k, v in row.items() if k not in ("account_id", "period")) == 10


def test_a_month_with_very_many_tags(spark, hot_rows, ledger):
    hot_rows(50)
    rows = ledger(*[{"tag": f"t{i}", "amount": -1 if i else 500, "date": dt.date(2001, 7 if i % 2 else 5, 1)} for i in range(600)])
    cells = shares.spend_by_period(rows, "tag", "month", trailing=2)
    assert cells.count() == 300
    year = shares.percent_of_income(shares.spend_by_period(rows, "tag", "year"))
    assert year.count() == 600 and year.agg(F.sum("percent")).first()[0] == pytest.approx(599 * 0.2)


def test_hot_keys_are_few_and_cut_small(hot_rows, lopsided):
    hot_rows(20)
    hot = {r.account_id: r.pieces for r in skew.hot_keys(
        skew.key_counts(lopsided, ["account_id"]), ["account_id"]).collect()}
    assert hot == {1: 10}


def test_no_key_is_hot_below_the_floor(lopsided):
    assert skew.hot_keys(skew.key_counts(lopsided, ["account_id"]), ["account_id"]).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_keeps_every_row_once(spark, hot_rows, lopsided, how):
    hot_rows(20)
    lookup = spark.createDataFrame([(1, "one"), (2, "two")], "account_id long, name string")
    got = skew.lookup_join(lopsided, lookup, ["account_id"], ["tid"], how)
    names = {1: "one", 2: "two"}
    expected = {r.tid: names.get(r.account_id) for r in lopsided.collect()}
    if how == "inner":
        expected = {k: v for k, v in expected.items() if v}
    rows = got.collect()
    assert {r.tid: r.name for r in rows} == expected and len(rows) == len(expected)


def test_pieces_spread_the_hot_key(hot_rows, lopsided):
    hot_rows(20)
    hot = skew.hot_keys(skew.key_counts(lopsided, ["account_id"]), ["account_id"])
    dealt = lopsided.join(hot, "account_id").groupBy(F.pmod(F.xxhash64("tid"), F.col("pieces"))).count()
    assert dealt.agg(F.max("count")).first()[0] < 40


def test_rows_with_null_keys_are_spread_too(spark, hot_rows):
    hot_rows(10)
    rows = spark.range(400).select("id", F.lit(None).cast("long").alias("k"))
    lookup = spark.createDataFrame([(1, "one"), (None, "none")], "k long, name string")
    counts = skew.key_counts(rows, ["k"])
    assert [(r.k, r.pieces) for r in skew.hot_keys(counts, ["k"]).collect()] == [(None, 40)]
    assert skew.lookup_join(rows, lookup, ["k"], ["id"]).where("name is null").count() == 400
    assert skew.lookup_join(rows, lookup, ["k"], ["id"], nulls_match=True).where("name = 'none'").count() == 400
    assert skew.lookup_join(rows, lookup, ["k"], ["id"], "left_anti").count() == 400


def test_many_copies_reduce_before_the_shuffle(spark):
    copies = spark.range(5000).select(
        F.col("id").alias("pos"), F.lit(1).alias("account_id"),
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("amount"))
    kept = dedup.first_of_each(copies, ["account_id", "amount"])
    assert sorted(r.pos for r in kept.collect()) == sorted([1, *range(0, 5000, 10)])


def test_columnwise_with_a_hot_value(spark, hot_rows):
    """A row goes when each of its values occurs in its column, in any row."""
    hot_rows(2)
    shape = "pos long, account_id long, amount int, type string"
    seen = spark.createDataFrame([(0, 1, 1, "x"), (0, 1, 2, "y"), (0, 2, 9, None)], shape)
    new = spark.createDataFrame([
        (1, 1, 1, "y"), (2, 1, 1, "z"), (3, 1, 3, "z"), (4, 1, 7, "z"), (5, 1, 8, "z"),
        (6, 2, 9, None), (7, 2, 9, "x"), (8, 3, 1, "x")], shape)
    kept = dedup.new_rows_columnwise(new, seen, ["amount", "type"])
    assert sorted(r.pos for r in kept.collect()) == [2, 3, 4, 5, 7, 8]
    assert sorted(r.pos for r in dedup.new_rows(new, seen, ["account_id", "amount", "type"]).collect()) == [
        1, 2, 3, 4, 5, 7, 8]


def test_columnwise_takes_one_column_at_a_time(spark, monkeypatch):
    """No task holds the values of several columns: what is written for a column is made of that column alone."""
    written = []
    monkeypatch.setattr(dedup, "stored", lambda frame, purpose: written.append(frame) or frame)
    rows = spark.createDataFrame([(1, 1, 5, "x"), (2, 1, 6, "y")], "pos long, account_id long, amount int, type string")
    assert [r.pos for r in dedup.new_rows_columnwise(rows, rows.where("pos = 1"), ["amount", "type"]).collect()] == [2]
    assert len(written) == 4
    assert all("Generate" not in f._jdf.queryExecution().optimizedPlan().toString() for f in written[::2])  # the others repeat hot values


def test_running_total_reads_what_it_wrote_as_columns(spark, ledger, openings):
    """The ranged rows are a file that the planner knows, not a dump of whole rows."""
    plan = skew.running_total(ledger({}, {"account_id": 2}), openings(a1="3"))._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan


def test_columnwise_rows_without_an_account_stay(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, 1, 5)], "pos long, account_id long, amount int")
    assert [r.pos for r in dedup.new_rows_columnwise(rows, rows, ["amount"]).collect()] == [1]
