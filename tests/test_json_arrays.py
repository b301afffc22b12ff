"""Arrays of JSON records, cut at any byte, against a JSON parser."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import star
from ledgerloom.sources.json_arrays import array_text, read_array, record_texts
from ledgerloom.sources.uploads import JSON_SCHEMA

SCHEMA = "i long, s string, o string"


@pytest.fixture
def blocks(spark):
    """Sets the bytes of a block of a file, for one test."""
    def use(n: int) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield use
    for name in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{name}")


def read(spark, path):
    return [(r.i, r.s, None if r.o is None else json.loads(r.o))
            for r in read_array(spark, str(path), SCHEMA, "*.json").orderBy("i").collect()]


def parsed(text):
    found = json.loads(text)
    return sorted((r["i"], r.get("s"), r.get("o")) for r in (found if isinstance(found, list) else [found]))


STRINGS = ["", "}", "{", "}}{", '"', '\\', '\\"}', "a}b{c", "],[", "}, {", "\n}\n", "é}ü", "{\"x\": \"}\"}", "\\\\", "plain", "'"]


def records(seed, n):
    draw = random.Random(seed)

    def inner(deep):
        if deep == 0 or draw.random() < 0.4:
            return draw.choice(STRINGS)
        return {draw.choice(STRINGS): inner(deep - 1)} if draw.random() < 0.6 else [inner(deep - 1) for _ in range(draw.randrange(3))]

    return [{"i": i, "s": "".join(draw.choice(STRINGS) for _ in range(draw.randrange(4))), **({"o": {"k": inner(3)}} if draw.random() < 0.4 else {})}
            for i in range(n)]


@pytest.mark.parametrize("seed, size, spaced", [(1, 7, None), (2, 64, 1), (3, 10**6, 2)])
def test_cut_anywhere(spark, tmp_path, blocks, seed, size, spaced):
    rows = records(seed, 120)
    texts = [json.dumps(rows[:70], indent=spaced, ensure_ascii=seed % 2 == 0), json.dumps(rows[70:], indent=spaced)]
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text, encoding="utf-8")
    blocks(size)
    assert read(spark, tmp_path) == sorted(x for t in texts for x in parsed(t))


WHOLE = [
    "[]", " [ ] \n", '{"i": 1}', '  {"i": 1, "s": "}"}\n', '[{"i": 1}]', '\n[\n{"i": 1}\n,\n{"i": 2}\n]\n', '[{"i": 1, "o": {"a": {"b": "}"}}}]', '[{"i": 1, "s": "\\\\"}]']


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_whole_files(spark, tmp_path, blocks, size):
    for i, text in enumerate(WHOLE):
        (tmp_path / f"{i}.json").write_text(text)
    blocks(size)
    found = {}
    for r in read_array(spark, str(tmp_path), SCHEMA, "*.json").collect():
        found.setdefault(int(r.file.rsplit("/", 1)[1][:-5]), []).append((r.i, r.s, None if r.o is None else json.loads(r.o)))
    assert {i: sorted(rows) for i, rows in found.items()} == {i: parsed(t) for i, t in enumerate(WHOLE) if parsed(t)}


def test_order_marks_empty_files_and_no_files(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'\xef\xbb\xbf{"i": 1}')
    (tmp_path / "b.json").write_bytes(b'\xef\xbb\xbf[{"i": 2}]')
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.txt").write_text("no")
    assert read(spark, tmp_path) == [(1, None, None), (2, None, None)]


@pytest.mark.parametrize("text", [
    "no", '[{"i": 1}', '[{"i": 1}, {"i": 2', '{"i": 1', '[{"i": 1} {"i": 2}]', '[{"i": 1},]', '[{"i": 1}] x', '[{"i": 1}]]', '[{"i": 1}}]', "[1]",
    '[{"i": 1}, 2, {"i": 3}]', '[{"i": 1, "s": "x]', '[{"i": 1, "s": "x"}], {"i": 2}', '[{"i": "x"}]', '[{"i": 1 "s": "x"}]', '{"i": 1}{"i": 2}', "[", "]x", '[[{"i": 1}]]'])
def test_files_that_are_none(spark, tmp_path, blocks, text):
    (tmp_path / "a.json").write_text(text)
    blocks(3)
    with pytest.raises(Exception, match="not an array|MALFORMED"):
        read(spark, tmp_path)


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path, blocks):
    folder = "/root/testdata/sf0.001"
    rows = star.ledger(spark, folder).withColumn("closing_balance", F.lit(0.0))
    texts = [r[0] for r in rows.select(F.to_json(F.struct("*"))).collect()]
    (tmp_path / "a.json").write_text("[" + ", ".join(texts) + "]")  # one line
    size = (tmp_path / "a.json").stat().st_size
    blocks(size // 20)
    scan = spark.read.option("lineSep", "}").text(str(tmp_path))
    assert scan.rdd.getNumPartitions() >= 20
    found = read_array(spark, str(tmp_path), JSON_SCHEMA, "*.json")
    assert found.count() == len(texts) and found.select("pos").distinct().count() == len(texts)
    assert sorted(r.tid for r in found.select("tid").collect()) == sorted(json.loads(t)["tid"] for t in texts)
    # The positions follow the order of the file.
    assert [r.record for r in record_texts(array_text(scan)).orderBy("pos").collect()] == texts
