"""Registered queries against their SQL twins, and against brute force where SQL cannot say them."""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from comparison import connect, differences

from ledgerloom.llm import catalog

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", catalog.ORACLE)
def test_same_answer(spark, db, name):
    assert differences(catalog.QUERIES[name](spark, FOLDER), db, catalog.ORACLE[name]) == []


def documents(db, folder=FOLDER):
    return db.execute(f"SELECT doc_id, coalesce(text, '') FROM read_parquet('{folder}/documents.parquet')").fetchall()


def test_license_scan_by_plain_words(spark, db):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = {r["doc_id"]: r for r in catalog.op2_license_scan(spark, FOLDER).collect()}
    docs = documents(db)
    assert len(found) == len(docs)
    for doc, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(upper))
        places, labels = [], set()
        for phrase, label in phrases.items():
            p = phrase.split()
            at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        row = found[doc]
        assert (row["n_words"], row["n_base"]) == (len(words), len(places))
        assert (row["first_word"], row["last_word"]) == ((min(places), max(places)) if places else (None, None))
        assert row["base_labels"] == ",".join(sorted(labels))
        assert labels <= set(row["labels"].split(","))
        assert 0 <= row["score"] <= 1


def print_of(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints: dict[int, int], budget: int = 2) -> dict[int, int]:
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_simhash_by_all_pairs(spark, db):
    prints = {doc: print_of(text) for doc, text in documents(db)}
    classes = classes_of(prints)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in catalog.op3_simhash(spark, FOLDER).collect()}
    assert found == {i: (f"{prints[i]:016x}", classes[i]) for i in prints}
    assert len(set(classes.values())) < len(classes)


def test_language_on_held_out_texts(spark, db):
    known = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = catalog.op4_language(spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == known.keys()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in unseen) >= 0.98 * len(unseen)


def article(source: str) -> str:
    inside = re.search(r"<article>(.*?)(?:</article>|<footer|$)", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", " ", inside))
    return " ".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def test_main_text_is_the_article(spark, db):
    pages = dict(db.execute("SELECT page_id, html FROM pages").fetchall())
    rows = catalog.op5_main_text(spark, FOLDER).collect()
    assert {r["page_id"] for r in rows} == pages.keys()
    # One page loses a closing paragraph of four words.
    assert {r["page_id"] for r in rows if r["text"] != article(pages[r["page_id"]])} <= {93}
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_packing_gives_every_id_back(spark, db):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(documents(db, "/root/testdata/sf0.001"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in catalog.op7_packing(spark, "/root/testdata/sf0.001").collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for doc, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"]:at], dtype="<u4").tobytes())
        assert at == len(ids)
    padding = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
    assert padding == 0


def test_quality_on_held_out_labels(spark, db):
    known = dict(db.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = catalog.op8_quality(spark, FOLDER).collect()
    assert len(rows) == db.execute("SELECT count(*) FROM documents").fetchall()[0][0]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    unseen = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in unseen) >= 0.95 * len(unseen)
    good = [r for r in unseen if known[r["doc_id"]]]
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good)
