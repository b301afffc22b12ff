from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from ledgerloom.plans.skew import PIECE_SETTING  # noqa: E402
from ledgerloom.schema import LEDGER  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
AS_OF = dt.date(2001, 7, 15)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield session
    session.stop()


@pytest.fixture
def hot_rows(spark):
    """Sets the number of rows above which a key is hot, for one test."""
    def use(n: int) -> None:
        spark.conf.set(PIECE_SETTING, str(n))

    yield use
    spark.conf.unset(PIECE_SETTING)


@pytest.fixture
def ledger(spark):
    """Ledger rows from dicts; what is left out has a plain default."""
    def make(*rows: dict):
        full = []
        for i, r in enumerate(rows):
            r = {"tid": i, "account_id": 1, "date": AS_OF, "amount": "0", "type": "Cash",
                 "description": "d", "category": "c", "subcategory": "s", "tag": "t",
                 "status": True, "payee": "p", **r}
            r["amount"] = None if r["amount"] is None else Decimal(str(r["amount"]))
            full.append(tuple(r[f] for f in LEDGER.fieldNames()))
        return spark.createDataFrame(full, LEDGER)

    return make


@pytest.fixture
def openings(spark):
    def make(**amounts):
        return spark.createDataFrame(
            [(int(k.lstrip("a")), Decimal(v)) for k, v in amounts.items()],
            "account_id long, opening decimal(18,2)")

    return make


@pytest.fixture
def generated(ledger):
    """One account, 24 rows every 15 days from 2018-01-16, -110, -120, ... -340."""
    first = dt.date(2018, 1, 16)
    return ledger(*[
        {"tid": i, "date": first + dt.timedelta(days=15 * i), "amount": -(110 + 10 * i),
         "category": "Household", "subcategory": "Groceries", "tag": "Routine"} for i in range(24)])
