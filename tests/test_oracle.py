"""Every ledger query against its SQL twin."""

from __future__ import annotations

import pytest
from __spark_entry__ import entry
from comparison import connect, differences

from ledgerloom.catalog.oracle import ORACLE
from ledgerloom.catalog.queries import QUERIES

# Large enough for every query to have rows.
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_same_answer(spark, db, name):
    assert differences(QUERIES[name](spark, FOLDER), db, ORACLE[name]) == []


@pytest.mark.parametrize("name", [
    "closing_balance_l12m_outgo", "trailing_months_12", "percent_of_income_tag", "avg_month_category",
    "latest_transactions", "clamped_filter", "budget_gauge", "new_rows_columnwise",
    "holder_transactions", "held_accounts", "ingest_bank_statement", "spend_by_period_tag_l3m",
])
def test_same_answer_when_keys_are_hot(spark, db, hot_rows, name):
    hot_rows(2)
    assert differences(QUERIES[name](spark, FOLDER), db, ORACLE[name]) == []


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["account_id", "period", "subject", "income", "percent"]
    assert rows.count() > 0
