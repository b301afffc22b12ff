"""The table query's parameters, searches, pages and facets."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_search_pattern
from ledgerloom.operators import filters
from ledgerloom.operators.table_query import TableColumn, TableQuery, TableRequest
from ledgerloom.sources import page_index

NOW = dt.datetime(2001, 7, 15, 12)
METHODS = ["numeric", "date", "yadcf_range_number", "yadcf_range_number_slider", "yadcf_range_date",
           "yadcf_multi_select", "yadcf_bool_select", "yadcf_autocomplete", "string_contains", "like", "ilike", "none"]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([
        (1, Decimal("1.50"), dt.date(2001, 1, 1), "Alpha", True),
        (2, Decimal("2.00"), dt.date(2001, 7, 15), "beta|x", False),
        (3, None, None, None, None),
        (4, Decimal("-3.25"), dt.date(2001, 12, 31), "50% al.", True),
        (5, Decimal("0"), dt.date(1999, 1, 1), "back\\slash", False)],
        "id long, n decimal(18,2), d date, s string, b boolean")


def search(rows, column, method, value):
    query = TableQuery(rows, [TableColumn(column, search_method=method)], TableRequest({0: value}), "id", NOW)
    return sorted(r.id for r in query.filtered().collect())


@pytest.mark.parametrize("column, method, value, expected", [
    ("n", "numeric", ">1.5", [2]), ("n", "numeric", ">=1.5", [1, 2]), ("n", "numeric", "= 2", [2]),
    ("n", "numeric", "2", [2]), ("n", "numeric", "<", [4]), ("n", "numeric", "<=0", [4, 5]),
    ("n", "numeric", "<inf", [1, 2, 4, 5]),
    ("d", "date", ">2001-01-01", [2, 4]), ("d", "date", "1 January 2001", [1]),
    ("d", "date", "<nonsense", [1, 2, 5]), ("d", "date", ">=2001-12-30 10:00", [4]),
    ("n", "yadcf_range_number", "-yadcf_delim-", [1, 2, 4, 5]), ("n", "yadcf_range_number_slider", "0-yadcf_delim-1.5", [1, 5]),
    ("d", "yadcf_range_date", "2001-01-01-yadcf_delim-", [1, 2, 4]), ("d", "yadcf_range_date", "-yadcf_delim-2001-01-01", [1, 5]),
    ("s", "yadcf_multi_select", "Alpha|50% al.", [1, 4]), ("n", "yadcf_multi_select", "1.50|0.00", [1, 5]),
    ("b", "yadcf_bool_select", "true", [1, 4]), ("b", "yadcf_bool_select", "other", [2, 5]),
    ("s", "yadcf_autocomplete", "Alpha", [1]), ("s", "yadcf_autocomplete", "alpha", []),
    ("s", "string_contains", "AL", [1, 4]), ("s", "yadcf_text", "al", [1, 4]), ("s", "string_contains", "\\", [5]),
    ("s", "like", "A%", [1]), ("s", "like", "a%", []), ("s", "ilike", "a%", [1]), ("s", "none", "zzz", [1, 2, 3, 4, 5]),
])
def test_search(rows, column, method, value, expected):
    assert search(rows, column, method, value) == expected


@pytest.mark.parametrize("text, pattern", [
    ("a|b", "a|b"), ("a||||b||", "a|b"), ("a.b*", r"a\.b\*"), ("\\d[x]{2}", r"d\[x]\{2\}"), ("^$?+()", r"\^\$\?\+\(\)"), ("|", ""),
])
def test_clean_pattern(text, pattern):
    assert clean_search_pattern(text) == pattern


def test_global_search(rows):
    columns = [TableColumn("n"), TableColumn("s"), TableColumn("d", global_search=False)]

    def found(text, **kw):
        q = TableQuery(rows, columns, TableRequest(search=text, regex=kw.pop("regex", False)), "id", NOW, **kw)
        return sorted(r.id for r in q.filtered().collect())

    assert found("5") == [1, 4]
    assert found("2001") == []
    assert found("al|beta", regex=True) == []
    assert found("al|beta", regex=True, allow_regex=True) == [2, 4]
    assert found("beta|x") == [2]


def test_errors(rows):
    columns = [TableColumn("n", search_method="numeric")]
    with pytest.raises(ValueError):
        TableColumn("n", search_method="nearly")
    with pytest.raises(ValueError):
        TableColumn("n", nulls_order="nullsbetween")
    for request in (TableRequest({0: "=>3"}), TableRequest({0: "three"}), TableRequest(length=-2),
                    TableRequest(order=[(0, "up")])):
        with pytest.raises(ValueError):
            TableQuery(rows, columns, request, "id", NOW)
    with pytest.raises(ValueError):
        TableRequest.from_params({"sEcho": "1"}, 1)


def test_params():
    request = TableRequest.from_params({
        "draw": "3", "start": "10", "length": "5", "search[value]": "x", "search[regex]": "true",
        "columns[1][search][value]": "y", "columns[0][search][value]": "",
        "order[0][column]": "1", "order[0][dir]": "desc", "order[1][column]": "0", "order[1][dir]": "asc"}, 2)
    assert request == TableRequest({1: "y"}, "x", True, [(1, "desc"), (0, "asc")], 10, 5, 3)


@pytest.mark.parametrize("direction, nulls, expected", [
    ("asc", None, [3, 4, 5, 1, 2]), ("desc", None, [2, 1, 5, 4, 3]),
    ("asc", "nullslast", [4, 5, 1, 2, 3]), ("desc", "nullsfirst", [3, 2, 1, 5, 4]),
])
def test_order_and_pages(rows, direction, nulls, expected):
    columns = [TableColumn("n", "amount", nulls_order=nulls), TableColumn("id")]

    def page(start, length):
        request = TableRequest(order=[(0, direction)], start=start, length=length)
        query = TableQuery(rows, columns, request, "id", NOW)
        assert query.page().columns == ["amount", "1"]
        return [r["1"] for r in query.page().collect()]

    assert page(0, -1) == expected
    assert page(0, 2) == expected[:2]
    assert page(2, 2) == expected[2:4]
    assert page(3, -1) == expected[3:]
    assert page(9, 2) == [] and page(0, 0) == []


def test_plans_of_pages(rows):
    """A page is a top-k and the rest a distributed sort: neither is one big task."""
    def plan(**kw):
        query = TableQuery(rows, [TableColumn("id")], TableRequest(order=[(0, "asc")], **kw), "id", NOW)
        return query.page()._jdf.queryExecution().executedPlan().toString()

    assert "TakeOrderedAndProject" in plan(start=3, length=2)
    assert "rangepartitioning" in plan(start=3) and "GlobalLimitAndOffset" not in plan(start=3)


def test_counts_and_facets(rows):
    columns = [TableColumn("b", "flag", "yadcf_bool_select"), TableColumn("s", "text", "yadcf_multi_select"),
               TableColumn("n", "n", "yadcf_range_number"), TableColumn("id", "id", "yadcf_autocomplete")]
    request = TableRequest({0: "true", 1: "Alpha|beta|x", 3: "1"}, draw=4)
    query = TableQuery(rows, columns, request, "id", NOW)
    assert tuple(query.counts().first()) == (5, 1, 4)
    assert [tuple(r) for r in query.facet_ranges().collect()] == [("n", -4, 2)]
    assert sorted(map(tuple, query.facet_values().collect())) == [("id", "1"), ("text", "Alpha")]
    everything = TableQuery(rows, columns, TableRequest(), "id", NOW).facet_values()
    assert ("text", None) in [tuple(r) for r in everything.collect()]


def test_ledger_filter_bounds(ledger):
    rows = ledger(*[{"amount": a, "date": dt.date(2001, 1, 1 + i), "category": c}
                    for i, (a, c) in enumerate([(-5, "Ab"), (0, "b"), (7, None), (None, "A")])])

    def kept(**kw):
        return sorted(r.tid for r in filters.ledger_filter(rows, filters.LedgerFilter(**kw)).collect())

    day = lambda d: dt.date(2001, 1, d)
    assert kept() == [0, 1, 2, 3]
    assert kept(date_from=day(2), date_to=day(3)) == [1, 2]
    assert kept(date_from=day(3), date_to=day(2)) == kept(date_from=day(2), date_to=day(2)) == [0, 1, 2, 3]
    assert kept(date_from=day(3)) == [2, 3] and kept(date_to=day(2)) == [0, 1]
    assert kept(amount_ge=Decimal(0)) == [1, 2] and kept(amount_le=Decimal(0)) == [0, 1]
    assert kept(amount_ge=Decimal(-5), amount_le=Decimal(10)) == [0, 1, 2]
    assert kept(category_like="^A") == [0, 3]


def test_clamped_filter(ledger):
    rows = ledger(*[{"account_id": a, "amount": n, "date": dt.date(2001, 1, d)}
                    for a, n, d in [(1, 1, 1), (1, 5, 9), (2, 2, 3), (2, 3, 5), (2, None, 5)]])

    def kept(**kw):
        return sorted(r.tid for r in filters.clamped_filter(rows, NOW.date(), **kw).collect())

    day = lambda d: dt.date(2001, 1, d)
    assert kept() == [0, 1, 2, 3]
    assert kept(date_from=day(4)) == [1, 3]
    assert kept(date_from=day(5)) == [1, 2, 3]
    assert kept(date_from=day(5), date_to=day(1)) == [0, 1, 2, 3]
    assert kept(date_from=day(2), date_to=dt.date(2999, 1, 1)) == [1, 2, 3]
    assert kept(amount_ge=Decimal(2), amount_le=Decimal(3)) == [2, 3]
    assert kept(amount_le=Decimal("2.5")) == [0, 2]
    # No end is above the least amount of account 2, so its range widens.
    assert kept(amount_le=Decimal(2)) == [0, 2, 3]


def test_status_and_nature(ledger):
    rows = ledger({"status": True, "amount": 0}, {"status": False, "amount": 1}, {"status": None, "amount": None})
    assert [r.tid for r in filters.completed(rows).collect()] == [0]
    assert [r.tid for r in filters.still_open(rows).collect()] == [1]
    assert [r.nature for r in filters.with_nature(rows).orderBy("tid").collect()] == ["outgo", "income", "outgo"]
    assert sorted(r.tid for r in filters.outgo(rows).collect()) == [0, 2]


def test_filtered_totals_of_nothing(ledger):
    none = filters.TableFilter(type="no such type")
    assert tuple(filters.filtered_totals(ledger({}), none).first()) == (0, 0)
    assert filters.table_filter(ledger({}), none).select(F.count("*")).first()[0] == 0


SORTS = [[(0, "asc")], [(0, "desc")], [(2, "asc"), (0, "desc")], [(1, "desc"), (2, "asc")], []]


@pytest.fixture(scope="module")
def tied(spark):
    """300 rows with few values, nulls among them."""
    made = [(i, None if i % 7 == 0 else Decimal(i % 5), None if i % 11 == 0 else dt.date(2001, 1, 1 + i % 3), None if i % 13 == 0 else "abc"[i % 3])
            for i in range(300)]
    return spark.createDataFrame(made, "id long, n decimal(18,2), d date, s string").cache()


def paged(tied, order, start=0, length=-1, searches=None, nulls=None):
    columns = [TableColumn("n", "n", "numeric", nulls_order=nulls), TableColumn("d", "d", "date"), TableColumn("s", "s"), TableColumn("id", "id", "numeric")]
    return TableQuery(tied, columns, TableRequest(searches or {}, order=order, start=start, length=length), "id", NOW)


@pytest.mark.parametrize("nulls", [None, "nullsfirst", "nullslast"])
@pytest.mark.parametrize("order", SORTS)
def test_the_page_after_any_row(tied, order, nulls):
    everything = paged(tied, order, nulls=nulls).page().collect()
    for i in (0, 41, 222, 296):
        after = paged(tied, order, length=4, nulls=nulls).following(everything[i].asDict())
        assert after.collect() == everything[i + 1:i + 5]


def test_the_page_after_a_row_is_a_top_k_with_a_bound_for_the_scan(spark, tied, tmp_path):
    tied.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    last = {"n": Decimal(3), "id": 30}
    plan = paged(stored, [(0, "asc")], length=4).following(last)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(n,3" in plan
    long = paged(stored, [(0, "asc")], length=20_000).following(last)
    assert long.collect() == paged(stored, [(0, "asc")]).following(last).collect()


@pytest.fixture(scope="module")
def index(tied, tmp_path_factory):
    # 300 rows are too few for several ranges, unless adaptive execution leaves them apart.
    tied.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield page_index.build(paged(tied, SORTS[2], searches={3: "<290"}), str(tmp_path_factory.mktemp("pages") / "index"), version=3)
    tied.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_pages_of_an_index(spark, tied, index):
    everything = paged(tied, SORTS[2], searches={3: "<290"}).page().collect()
    assert index.n_rows == len(everything) == 290 and sum(n > 0 for n in index.sizes) > 2
    again = page_index.open_index(spark, index.path, version=3)
    assert again == index
    for start, length in [(0, 5), (0, -1), (3, 0), (70, 3), (71, 150), (140, -1), (285, 50), (290, 5), (1000, 5)]:
        query = paged(tied, SORTS[2], start, length, {3: "<290"})
        assert again.page(query).collect() == everything[start:][:length if length >= 0 else None], (start, length)


def test_a_page_of_an_index_opens_the_parts_that_hold_it(spark, tied, index):
    files = len(index.rows(spark).inputFiles())
    first, second = (index.page(paged(tied, SORTS[2], s, 3, {3: "<290"})) for s in (250, 253))
    for page in (first, second):
        assert 1 <= len(page.inputFiles()) <= 2 < files
        plan = page._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning(__part" in plan or "TakeOrdered" in plan
        assert "Exchange hash" not in plan and "ExistingRDD" not in plan


def test_an_index_refuses_other_requests(spark, tied, index):
    with pytest.raises(page_index.OtherRequest):
        index.page(paged(tied, SORTS[2]))
    with pytest.raises(page_index.OtherRequest):
        index.page(paged(tied, SORTS[0], searches={3: "<290"}))
    with pytest.raises(page_index.OtherRequest):
        page_index.open_index(spark, index.path, version=4)


def test_an_index_of_no_rows(spark, tied, tmp_path):
    query = paged(tied, SORTS[0], 2, 5, {3: "<0"})
    made = page_index.build(query, str(tmp_path / "none"))
    assert made.n_rows == 0 and made.page(query).collect() == [] and made.page(query).columns == ["n", "d", "s", "id"]
