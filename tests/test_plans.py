"""How often plans read their tables, and pivots of many subjects."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.catalog.queries import QUERIES
from ledgerloom.operators import shares

FOLDER = "/root/testdata/sf0.001"


def scans(frame) -> int:
    """Scans of files in the plan as it is first made, before equal parts are reused."""
    return frame._jdf.queryExecution().sparkPlan().toString().count("FileScan")


@pytest.mark.parametrize("name, most", [
    ("percent_of_income_tag_l12m", 9), ("percent_of_income_category", 6), ("avg_month_category", 4), ("refresh_budgets", 9), ("closing_balance_l12m_outgo", 13)])
def test_scans_of_trailing_plans(spark, name, most):
    assert scans(QUERIES[name](spark, FOLDER)) <= most


@pytest.fixture
def many(spark):
    """50,000 subjects in one year of one account, 10 in another's."""
    one = spark.range(50_000).select(F.lit(1).cast("long").alias("account_id"), F.lit(2001).alias("period"), F.concat(F.lit("t`"), "id").alias("subject"), F.lit(Decimal("1.50")).alias("net"))
    two = spark.range(10).select(F.lit(2).cast("long"), F.lit(None).cast("int"), F.concat(F.lit("t`"), "id"), F.col("id").cast("decimal(18,2)"))
    return one.union(two)


def test_pivot_of_very_many_subjects(many):
    with pytest.raises(ValueError):
        shares.pivot(many)
    rows = shares.pivot_groups(many).collect()
    found = {}
    for r in rows:
        assert 0 < len(r.nets) <= 2_000
        for subject, net in r.nets.items():
            assert (r.account_id, r.period, subject) not in found
            found[r.account_id, r.period, subject] = net
    assert found == {(r.account_id, r.period, r.subject): r.net for r in many.where("net <> 0").collect()}
    # A subject's group is the same in every row.
    groups = {}
    for r in rows:
        for subject in r.nets:
            assert groups.setdefault(subject, r.subject_group) == r.subject_group
    assert sum(found[k] for k in found if k[0] == 1) == 75_000


def test_pivot_of_odd_names_and_of_nothing(many):
    few = many.where("account_id = 2")
    (row,) = shares.pivot(few).collect()
    assert row["t`3"] == 3 and row["t`0"] == 0
    assert shares.pivot(few.limit(0)).collect() == [] and shares.pivot_groups(few.limit(0)).collect() == []
