"""What must hold between operators, over the given tables."""

from __future__ import annotations

import pytest
from conftest import AS_OF, FOLDER
from pyspark.sql import functions as F

from ledgerloom.catalog.queries import _table, FACET_REQUEST, QUERIES
from ledgerloom.operators import balances, cleaning, dedup, filters, shares
from ledgerloom.sources import star


@pytest.fixture(scope="module")
def done(spark):
    return filters.completed(star.ledger(spark, FOLDER)).checkpoint()


def test_last_running_balance_is_the_closing_balance(spark, done):
    running = balances.running_balance(done, star.openings(spark, FOLDER))
    last = running.groupBy("account_id").agg(F.max_by("closing_balance", F.struct("date", "tid")).alias("last"))
    overview = balances.account_overview(star.accounts(spark, FOLDER), star.ledger(spark, FOLDER))
    assert last.join(overview, "account_id").where("last <> closing_balance").count() == 0
    assert overview.where("pending_transactions > total_transactions").count() == 0


@pytest.mark.parametrize("subject", ["tag", "category", "subcategory"])
def test_cells_add_up_to_the_ledger(done, subject):
    cells = shares.spend_by_period(done, subject, "month")
    booked = done.where(F.col(subject).isNotNull()).agg(F.sum("amount")).first()[0]
    assert cells.agg(F.sum("net")).first()[0] == booked
    assert filters.completed(done).count() == done.count()


def test_an_upload_given_twice_adds_nothing(spark):
    rows = cleaning.homebank_rows(star.homebank_raw(spark, FOLDER))
    both = rows.unionByName(rows.withColumn("pos", F.col("pos") + 10**9))
    assert dedup.first_of_each(both).count() == rows.count()
    assert dedup.new_rows(rows, rows).count() == 0


def test_facets_cover_the_filtered_values(spark):
    query = _table(spark, FOLDER, **FACET_REQUEST)
    facets = {(r.facet, r.value) for r in query.facet_values().collect()}
    kept = query.filtered().select("type", "category").distinct().collect()
    assert {("type", r.type) for r in kept} | {("category", r.category) for r in kept} <= facets


def test_due_dates_lie_in_their_span(spark):
    for kind in ("monthly", "weekly", "yearly"):
        due = QUERIES[f"next_due_{kind}"](spark, FOLDER)
        assert due.where("due < start_date or due > end_date").count() == 0


def test_trailing_rows_are_a_suffix(done):
    kept = filters.trailing_months(done, 3)
    assert filters.trailing_months(kept, 3).count() == kept.count()
    assert filters.latest_rows(done, AS_OF).count() <= done.count()
