"""Searches through the text index of a store: the same rows as without it, and the files they open."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.table_query import TableColumn, TableQuery, TableRequest
from ledgerloom.schema import LEDGER
from ledgerloom.sources import stores, text_index

NOW = dt.datetime(2001, 7, 15, 12)
COLUMNS = [TableColumn("description"), TableColumn("payee", search_method="ilike"), TableColumn("tag", search_method="like"),
           TableColumn("amount", search_method="numeric"), TableColumn("date", search_method="yadcf_range_date"), TableColumn("status", global_search=False)]
WORDS = ["Alpha beach", "STRASSE", "straße", "ΟΔΟΣ", "οδος", "ÉCLAIR", "a%b_c", "x.y|z[1]", "back\\slash", "ab", "", None, "🙂🙂🙂 three", "Mixed CASE text", "\n lines \n", "İstanbul"]


def ask(spark, ledger, searches=None, search="", regex=False):
    return TableQuery(stores.read_ledger(spark, ledger), COLUMNS, TableRequest(searches or {}, search, regex), "tid", NOW, allow_regex=True)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """One batch per word and a year of its own, so a folder each; then an index."""
    at = tmp_path_factory.mktemp("texts")
    path, index = str(at / "ledger"), str(at / "index")
    rows = [(i, 1 + i % 2, dt.date(1990 + i, 1, 2), Decimal(i) / 4, "Cash", word, "c", "s", (WORDS[i - 1] or "t"), i % 3 == 0, f"payee {word}")
            for i, word in enumerate(WORDS)]
    stores.append_rows(spark.createDataFrame(rows, LEDGER), path, "words")
    assert text_index.catch_up(spark, path, index) and text_index.catch_up(spark, path, index) == []
    return path, index


SEARCHES = [
    {"search": s} for s in ("beach", "strasse", "οδος", "éclair", "a%b", "ash%sl", "🙂🙂🙂", "ab", "1993-01", "istan", "no such", "lines \n")
] + [{"search": s, "regex": True} for s in ("x.y", "z[1]", "beach|CASE", "ΔΟ|no such", "k\\s", "|beach", "nothing here")] + [
    {"searches": s} for s in ({0: "lpha"}, {1: "payee m%text"}, {1: "PAYEE ÉCLAIR"}, {2: "Mixed%"}, {2: "mixed%"}, {0: "text", 2: "thr%"}, {3: ">2"}, {0: "CASE", 3: ">100"}, {4: "1990-01-01-yadcf_delim-1991-12-31", 0: "alp"})]


def test_the_same_rows_as_without_an_index(spark, store):
    for asked in SEARCHES:
        plain = ask(spark, store[0], **asked)
        found = text_index.narrowed(plain, *store).filtered()
        assert sorted(r.tid for r in found.select("tid").collect()) == sorted(r.tid for r in plain.filtered().select("tid").collect()), asked


def test_files_opened(spark, store):
    def opened(**asked):
        return len(text_index.narrowed(ask(spark, store[0], **asked), *store).rows.inputFiles())

    every = len(stores.read_ledger(spark, store[0]).inputFiles())
    assert every >= len(WORDS)
    assert opened(search="beach") == 2  # its own row's, and the next row's tag
    assert opened(searches={0: "beach"}) == 1 and opened(searches={0: "beach", 1: "%three"}) == 0
    assert opened(search="beach|Mixed", regex=True) == 4 and opened(search="no such") == 0
    for asked in ({"search": "ab"}, {"search": "a%b"}, {"search": "|beach", "regex": True}, {"searches": {3: ">2"}}):
        assert opened(**asked) == every


def test_changes_after_the_index(spark, store, tmp_path, ledger):
    path, index = str(tmp_path / "ledger"), str(tmp_path / "index")

    def tids(text):
        plain = ask(spark, path, search=text)
        found = sorted(r.tid for r in text_index.narrowed(plain, path, index).filtered().collect())
        assert found == sorted(r.tid for r in plain.filtered().collect())
        return found

    stores.append_rows(ledger({"description": "first one"}, {"description": "other", "date": dt.date(2003, 1, 1)}), path, "a")
    assert tids("first") == [0]  # no index yet
    text_index.catch_up(spark, path, index)
    stores.append_rows(ledger({"description": "first again"}), path, "b")
    assert tids("first") == [0, 2]
    assert [f.batch for f in text_index.catch_up(spark, path, index)] == ["b"]
    assert tids("first") == [0, 2]
    stores.edit_ledger(spark, path, stores.read_ledger(spark, path).where("tid = 0").withColumns({"description": F.lit("changed"), "seq": F.lit(1)}))
    assert tids("first") == [2] and tids("changed") == [0]
    text_index.catch_up(spark, path, index)
    assert tids("first") == [2] and tids("changed") == [0]
    stores.remove_rows(spark, path, stores.read_ledger(spark, path).where("tid = 2"))
    text_index.catch_up(spark, path, index)
    assert tids("first") == [] and tids("other") == [1]
    with pytest.raises(FileNotFoundError):
        text_index.catch_up(spark, str(tmp_path / "none"), index)
