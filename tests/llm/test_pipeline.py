"""The stages on given tables, against brute force, and the guard around their import."""

from __future__ import annotations

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from comparison import connect
from test_queries import classes_of, print_of
from tokenizers import Tokenizer

from ledgerloom.llm import catalog
from ledgerloom.llm.words import plain_shingles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gave, by position; first the documents."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], FOLDER).write.parquet(at)
        out.append(spark.read.parquet(at))
    return out


def rows(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_all_but_the_last_return_documents(stages):
    for frame in stages[:-1]:
        assert frame.columns == stages[0].columns


def test_quality_keeps_good_documents(stages):
    labels = dict(connect(FOLDER).execute("SELECT doc_id, quality FROM labels").fetchall())
    before, after = rows(stages[0]), rows(stages[1])
    good = [d for d in before if labels.get(d) == 1]
    assert sum(d in after for d in good) >= 0.98 * len(good)
    bad = [d for d in before if labels.get(d) == 0]
    assert sum(d not in after for d in bad) >= 0.8 * len(bad)


def test_exact_stage(stages):
    before, best = rows(stages[1]), {}
    for d, t in before.items():
        key = "".join(c for c in t if c not in " \t\n\v\f\r")
        best[key] = min(best.get(key, (0, d)), (-len(t), d))
    assert rows(stages[2]).keys() == {d for _, d in best.values()}


def test_simhash_stage(stages):
    before = rows(stages[2])
    assert rows(stages[3]).keys() == set(classes_of({d: print_of(t) for d, t in before.items()}).values())


def test_decontamination_stage(stages):
    items = [plain_shingles(t.encode(), 5) for (t,) in connect(FOLDER).execute("SELECT text FROM benchmark").fetchall()]
    clean = {d for d, t in rows(stages[3]).items()
             if not any(len(i & plain_shingles(t.encode(), 5)) >= 0.8 * len(i) for i in items)}
    assert rows(stages[4]).keys() == clean


def test_packing_stage_and_run(spark, stages):
    pieces, texts = defaultdict(list), rows(stages[4])
    for r in stages[5].collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"]
        pieces[r["doc_id"]].append((r["start"], r["ids"]))
    assert pieces.keys() == texts.keys()
    tokenizer = Tokenizer.from_file(catalog.vocabulary_path())
    for doc, text in texts.items():
        assert [i for _, ids in sorted(pieces[doc]) for i in ids] == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.agg({"length": "sum"}).collect() == stages[5].agg({"length": "sum"}).collect()
