"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import (
    catalog, chat, components, decontamination, dom, exact, extraction, language, licenses, packing, quality, simhash, warc, words)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", fingerprint string, score string, keep_id string, item_id string, text_sha256 string, component_id string, label string, `start` string"
WORDS = [f"w{i}x{i * i % 97}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def docs(spark):
    def make(*rows, clash: bool = False):
        """Rows of (doc_id, text)."""
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        if clash:
            return spark.createDataFrame([(*r, *["x"] * 8) for r in full], DOCS + CLASHING)
        return spark.createDataFrame(full, DOCS)

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "!?"), (None, "some words without an id here"), (5, "same text"), (5, "same text"), (6, None)]


@pytest.fixture
def odd(docs):
    return docs(*ODD, (7, prose(1, 60_000)), clash=True)


# Words


def test_words_are_those_of_the_pattern():
    texts = [b"One, TWO-three\xc3\x84b 4", b"", b"x" * 3_000_000 + b" end", b"A" + b" b" * 5]
    found = words.find_words(texts)
    assert found.counts().tolist() == [len(words.plain_words(t)) for t in texts]
    spans = [found.data[a:b].lower() for a, b in zip(found.starts, found.ends, strict=True)]
    assert spans == [w for t in texts for w in words.plain_words(t)]
    by_word = {}
    for h, w in zip(found.hashes.tolist(), spans, strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_shingles_stay_inside_texts():
    texts = [b"a b c d e f", b"a b c", b"", b"a b c", b"b c d e f"]
    hashes, owner = words.shingles(words.find_words(texts), 5)
    assert owner.tolist() == [0, 0, 1, 3, 4]
    assert hashes[2] == hashes[3] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 3


# 1 decontamination


def test_leaks_match_brute_force(spark, docs):
    items = {i: prose(1000 + i, 4 + 7 * i) for i in range(1, 12)}
    rows = []
    rng = random.Random(3)
    for d in range(60):
        own = prose(d, 300).split()
        taken = items[rng.randint(1, 11)].split()
        for _ in range(rng.randint(0, 4)):
            taken[rng.randrange(len(taken))] = "changed"
        at = rng.randrange(len(own))
        rows.append((d, " ".join(own[:at] + taken + own[at:]).upper().replace(" ", ", ")))
    benchmark = spark.createDataFrame([*items.items(), (3, items[3]), (50, None), (51, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontamination.find_leaks(docs(*rows), benchmark).collect()}
    expected = {}
    for d, text in rows:
        own = words.plain_shingles(text.encode(), 5)
        for i, item in items.items():
            s = words.plain_shingles(item.encode(), 5)
            if len(s & own) / len(s) >= 0.8:
                expected[d, i] = len(s & own) / len(s)
    assert found == pytest.approx(expected) and found
    clean = {r["doc_id"] for r in decontamination.without_leaks(docs(*rows), benchmark).collect()}
    assert clean == {d for d, _ in rows} - {d for d, _ in expected}


def test_blocks_of_items_change_nothing(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame([(i, prose(i, 20)) for i in range(20)], "item_id long, text string")
    rows = docs(*[(i, prose(99, 30) + " " + prose(i, 20)) for i in range(0, 40, 2)])
    whole = sorted(map(tuple, decontamination.find_leaks(rows, benchmark).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    assert sorted(map(tuple, decontamination.find_leaks(rows, benchmark).collect())) == whole and len(whole) == 10
    assert decontamination.without_leaks(rows, benchmark).count() == 10


def test_leaks_of_odd_rows(spark, odd, docs):
    benchmark = spark.createDataFrame([(1, "same text"), (2, None), (3, "")], "item_id long, text string")
    assert [tuple(r) for r in decontamination.find_leaks(odd, benchmark).collect()] == [(5, 1, 1.0)]
    clean = decontamination.without_leaks(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2
    nothing = benchmark.where("false")
    assert decontamination.find_leaks(odd, nothing).count() == 0
    assert decontamination.without_leaks(odd, nothing).count() == odd.count()
    assert decontamination.find_leaks(docs(), benchmark).count() == 0


FRENCH = ("L'été où Élodie, l'élève d'à côté, a reçu ça: où est-ce qu'on ira, là-bas, près du très vieux château fort, après l'année, déjà "
          "passée à l'étranger, où Jürgen, die Straße, größer, war")
COPIES = [
    str.upper, lambda t: t.replace(", ", " — "), lambda t: f"“{t}”".replace("'", "’"), lambda t: t.replace("'", "ʼ"),
    lambda t: t.replace(", ", "\xa0, ").replace(": ", "\xa0:\u202f"), lambda t: unicodedata.normalize("NFD", t), lambda t: t.replace(" ", "\u3000"),
    lambda t: t.replace("château", "châ\xadteau").replace("passée", "pas\u200dsée"), lambda t: t.replace("'", "´"),
    lambda t: "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in t)]
UNSPACED = [
    "これは試験の問題です。次の文が読めたら答えなさい", "请阅读下面的文章并回答后面的问题", "จงอ่านข้อความต่อไปนี้แล้วตอบคำถาม"]


def test_typographic_copies_are_found(spark, docs):
    items = [FRENCH, *UNSPACED]
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    rows = [f"Déjà vu, à Köln. {prose(i, 40)} {copy(FRENCH)} {prose(90 + i, 40)} fin." for i, copy in enumerate(COPIES)]
    rows += [f"前{item[:3]}。前文{unicodedata.normalize('NFD', item)}後文です" for item in UNSPACED] + ["これは別の文章です。試験ではありません", FRENCH[:90]]
    found = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontamination.find_leaks(docs(*enumerate(rows)), benchmark).collect()}
    n = len(COPIES)
    assert found == pytest.approx({**{(i, 0): 1.0 for i in range(n)}, **{(n + i, 1 + i): 1.0 for i in range(len(UNSPACED))}})
    assert {r["doc_id"] for r in decontamination.without_leaks(docs(*enumerate(rows)), benchmark).collect()} == {len(rows) - 2, len(rows) - 1}


def test_short_items_are_found_inside_documents(spark, docs):
    items = ["alpha", "beta gamma", "delta beta alpha", "one two three four", "one two three four five", "one two three four five six"]
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    texts = [f"{prose(i, 60)} {item.upper()}, {prose(50 + i, 60)}" for i, item in enumerate(items)]
    texts += ["beta, then gamma", "two three four", "beta gamma", "one two three five", prose(9, 50)]
    found = {(r["doc_id"], r["item_id"], r["containment"]) for r in decontamination.find_leaks(docs(*enumerate(texts)), benchmark).collect()}
    expected = {(d, i, 1.0) for d, t in enumerate(texts) for i, item in enumerate(items) if f" {item} " in f" {t.lower().replace(',', '')} " and (d, i) != (6, 1)}
    assert found == expected and len(found) == 11
    clean = {r["doc_id"] for r in decontamination.without_leaks(docs(*enumerate(texts)), benchmark).collect()}
    assert clean == set(range(len(texts))) - {d for d, _, _ in expected}


# 2 licenses


def test_blocks_meet_the_threshold_exactly(docs):
    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = {r["doc_id"]: r for r in licenses.scan(docs(
        (1, f"first\n{notice}\nlast"), (2, "licensed under the gnu general public license version"),
        (3, "GNU General\nPublic License"), (4, "Apache License, Version 2.0 and under the MIT License"), (5, "CC BY-NC cc by nc"))).collect()}
    assert (rows[1]["labels"], rows[1]["base_labels"], rows[1]["score"]) == ("gpl-3", "", 1.0)
    assert rows[2]["labels"] == "" and rows[3]["labels"] == ""
    assert rows[4]["base_labels"] == "apache-2,mit" and rows[4]["n_base"] == 2
    assert (rows[5]["n_base"], rows[5]["first_word"], rows[5]["last_word"]) == (2, 0, 3)


@pytest.mark.parametrize("seed", range(40))
def test_overlap_counts_like_sets(seed):
    rng = random.Random(seed)
    a, b = (sorted(rng.sample(range(30), rng.randint(0, 20))) for _ in range(2))
    for need in range(1, 12):
        shared = sorted(set(a) & set(b))
        assert licenses.overlap(a, b, need) == (shared if len(shared) >= need else [])


def test_license_scan_of_odd_rows(odd, docs):
    rows = licenses.scan(odd).collect()
    assert len(rows) == len(ODD) + 1
    for r in rows:
        assert (r["n_base"], r["first_word"], r["labels"], r["score"]) == (0, None, "", 0.0)
    assert licenses.scan(docs()).count() == 0


WRAPPED = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"),
    ("bsd", " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted"),
    ("gpl-3", "# This work is licensed under the GNU General\n# Public License, version 3."),
    ("gpl-2", "This work is licensed under the GNU\n\nGeneral Public License,\r\nversion 2."),
    ("", "This work is licensed under the GNU" + " and so on" * 9 + " General Public License, version 3.")]


def test_wrapped_notices_are_found(docs):
    rows = {r["doc_id"]: r for r in licenses.scan(docs(*[(i, f"{prose(i, 70)}\n{t}\n{prose(i, 70)}") for i, (_, t) in enumerate(WRAPPED)])).collect()}
    assert [(rows[i]["labels"], rows[i]["score"]) for i in range(len(WRAPPED))] == [(label, 1.0 if label else 0.0) for label, _ in WRAPPED]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_match_brute_force(docs, seed):
    rng = random.Random(seed)
    templates = {f"t{i}": [" ".join(rng.choice(WORDS[:30]) for _ in range(rng.randint(1, 9))) for _ in range(2)] for i in range(6)}
    texts = [rng.choice([" ", "\n", "\n\n# "]).join(rng.choice(WORDS[:60]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    for i in range(0, 120, 3):
        notice = rng.choice(rng.choice(list(templates.values()))).split()
        notice[rng.randrange(len(notice))] = "changed"
        texts[i] += "\n".join(["", *notice, ""]) + texts[i - 1]
    rows = {r["doc_id"]: r for r in licenses.scan(docs(*enumerate(texts)), templates=templates, phrases={"no phrase": "x"}).collect()}
    some = 0
    for i, text in enumerate(texts):
        found, best = words.plain_words(text.encode()), {}
        for label, notices in templates.items():
            for notice in notices:
                own, span = words.plain_words(notice.encode()), 2 * len(notice.split())
                top = max(len(set(own) & set(found[a:a + span])) / len(set(own)) for a in range(len(found)))
                if top >= 0.8 - 1e-9:
                    best[label] = max(top, best.get(label, 0))
        some += len(best) > 1
        assert (rows[i]["labels"], rows[i]["score"]) == (",".join(sorted(best)), pytest.approx(max(best.values(), default=0.0)))
    assert some


FAMILIES = [
    ("cc-by,cc-by-nc", "Licensed under CC BY 4.0; figures licensed under CC BY-NC 4.0."), ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."), ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl-3,lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3. "
                     "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("gpl-2,gpl-3", "This work is licensed under the GNU General Public License, version 2 or version 3."),
    ("gpl-3", "This work is licensed under version 3 of the GNU General Public License."),
    ("gpl-2,gpl-3", "This work is licensed under the GNU General Public License."),
    ("gpl-3", "This work is licensed under the GNU General Public Licence, version 3."),
    ("", "This work is licensed under the GNU General Public License, version 1."),
    ("lgpl-3", "This work is licensed under the GNU Lesser General Public License, either version 3 of the License or a later one"),
    ("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License")]


def test_every_license_of_a_family_is_found(docs):
    rows = {r["doc_id"]: r for r in licenses.scan(docs(*enumerate(t for _, t in FAMILIES))).collect()}
    assert [rows[i]["labels"] for i in range(len(FAMILIES))] == [label for label, _ in FAMILIES]


NAMED = [
    ("gpl-3", "Released under the GNU General Public License, version 3."), ("apache-2", "Released under the Apache License, Version 2.0."),
    ("gpl-2", "Released under the GNU General Public License, version 2."), ("lgpl-3", "Released under the GNU Lesser General Public License, version 3."),
    ("apache-2,gpl-3", "Released under the Apache License, Version 2.0, or the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."), ("bsd", "Released under the BSD License."), ("bsd", "Released under the BSD 3-Clause License."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."), ("cc0", "Released under CC0 1.0 Universal."),
    ("apache-2", "Licensed under the Apache 2.0 license"), ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("", "The album was released under the Parlophone license"), ("", "The book was released under the MIT Press label, under license."),
    ("", "Version 1.0 Universal was released under protest"), ("", "This is free software released into the public domain"),
    ("", "He was released, and under the new license of the city many shops opened."),
    ("", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and documentation"),
    ("", "Licensed under the Apache License, Version 1.1.")]


def test_clean_lines_have_no_license(docs):
    rows = {r["doc_id"]: r for r in licenses.scan(docs(*enumerate(t for _, t in NAMED))).collect()}
    assert [rows[i]["labels"] for i in range(len(NAMED))] == [label for label, _ in NAMED]


# 3 SimHash


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
@pytest.mark.parametrize("limit", [4, 10**6])
def test_near_links_connect_like_all_pairs(spark, budget, limit):
    rng = random.Random(budget)
    centres = [rng.getrandbits(64) for _ in range(30)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for c in centres for _ in range(12)}
    values |= {centres[0] ^ (1 << b) for b in range(64)}
    signed = np.array(sorted(values), dtype=np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    links = simhash.near_links(prints, budget=budget, node_limit=limit).collect()
    mask = 2**64 - 1
    assert len(links) <= (budget + 1) * len(signed) or limit == 4

    def groups(pairs):
        root = {v: v for v in signed}

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in pairs:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
        return {v: top(v) for v in signed}

    every = [(a, b) for n, a in enumerate(signed) for b in signed[:n] if ((a ^ b) & mask).bit_count() <= budget]
    assert groups([(r["a"], r["b"]) for r in links]) == groups(every)


def test_traversal_in_small_parts(monkeypatch):
    rng = np.random.default_rng(1)
    values = np.unique(np.concatenate([np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64), rng.integers(0, 8, 50, dtype=np.uint64)]))
    start = np.array([[0, 0, len(values), 0, len(values), 0]])
    whole = sorted(p for a, b in simhash.traverse(values, start, 2) for p in zip(a.tolist(), b.tolist(), strict=True))
    monkeypatch.setattr(simhash, "MOST_PAIRS", 7)
    assert sorted(p for a, b in simhash.traverse(values, start, 2) for p in zip(a.tolist(), b.tolist(), strict=True)) == whole
    assert whole == [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 2]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2005, 2001), (2005, 2003), (7, 7)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(300)} | {n: 2001 for n in (2001, 2003, 2005)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_simhash_of_odd_rows(odd, docs):
    rows = [tuple(r) for r in simhash.classes(odd).select("doc_id", "fingerprint", "component_id").collect()]
    assert len(rows) == len(ODD) + 1
    assert {r[2] for r in rows if r[1] == 0} == {1}
    assert [r for r in rows if r[0] is None][0][2] is None
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 1, 4, 5, 7]
    assert simhash.classes(docs()).count() == 0 and simhash.deduplicate(docs()).count() == 0


@pytest.mark.parametrize("sent", [simhash.MOST_SENT, 0])
def test_one_id_with_several_texts_keeps_one_row_of_each_class(docs, monkeypatch, sent):
    monkeypatch.setattr(simhash, "MOST_SENT", sent)
    a, b, c = prose(1, 50), prose(2, 50), prose(3, 50)
    kept = simhash.deduplicate(docs((1, a), (1, b), (2, a), (3, b), (4, b), (1, a), (5, c), (5, c), (6, prose(4, 50))))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (5, c), (6, prose(4, 50))])


# 4 language


def test_language_of_odd_rows(odd, docs, spark):
    classifier = language.Classifier(["the cat and the dog", "der hund und die katze"] * 3, ["en", "de"] * 3)
    rows = {r["doc_id"]: r for r in language.identify(odd, classifier).collect()}
    assert {rows[i]["lang_pred"] for i in (1, 2, 3, 4, 6)} == {"und"} and rows[1]["score"] == 0
    assert rows[None]["lang_pred"] in ("en", "de") and rows[5]["lang_pred"] in ("en", "de")
    found = language.identify(docs((1, "der hund")), classifier).collect()
    assert found[0]["lang_pred"] == "de"
    numbers = docs(*enumerate(["\u00b2", "\u00bd 7_", "\u2460\u2167", "\u0301"]))
    assert {r["lang_pred"] for r in language.identify(numbers, classifier).collect()} == {"und"}
    none = language.fit(docs().where("lang is not null"))
    assert {r["lang_pred"] for r in language.identify(odd, none).collect()} == {"und"}
    assert language.identify(docs(), classifier).count() == 0


def test_presence_kernel_counts_shared_grams():
    grams = language.Grams()

    def plain(text):
        t = " " + text + " "
        return {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    a, b = "some words here", "other words there"
    classifier = language.Classifier([a, b], ["x", "y"], landmarks=2)
    block = classifier.kernel([grams(a), grams(b)])
    shared = len(plain(a) & plain(b)) / (len(plain(a)) * len(plain(b))) ** 0.5
    assert block == pytest.approx(np.array([[1, shared], [shared, 1]]), rel=1e-5)
    assert len(grams(a)) == len(plain(a))


# 5 main text


def test_decoding_is_the_best_consistent_choice():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 9)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        best = None
        for choice in range(1 << n):
            y = [choice >> i & 1 for i in range(n)]
            if y[0] and all(y[parents[i]] or not y[i] for i in range(1, n)):
                total = sum(o for o, c in zip(odds, y, strict=True) if c)
                best = max(total, best) if best is not None else total
        chosen = extraction.decode(parents, odds)
        assert all(chosen[parents[i]] or not chosen[i] for i in range(1, n))
        assert sum(o for o, c in zip(odds, chosen, strict=True) if c) == pytest.approx(best)


def test_decoding_gives_every_chosen_node_text():
    rng = random.Random(3)
    for _ in range(80):
        n = rng.randint(1, 9)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        odds, holds = [rng.uniform(-2, 2) for _ in range(n)], [rng.random() < 0.4 for _ in range(n)]

        def fits(y):
            return all((y[parents[i]] or not y[i]) and (not y[i] or holds[i] or any(y[j] and parents[j] == i for j in range(i + 1, n)))
                       for i in range(1, n))

        best = max(sum(o for i, o in enumerate(odds) if c >> i & 1) for c in range(1, 1 << n, 2) if fits([c >> i & 1 for i in range(n)]))
        chosen = extraction.decode(parents, odds, holds)
        assert fits(chosen) and sum(o for o, c in zip(odds, chosen, strict=True) if c) == pytest.approx(best)


@pytest.mark.parametrize("source, texts", [
    ("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>mc</mi><annotation encoding=tex>E=mc</annotation></math> here</p>", ["Energy is E=mc here"]),
    ("<p>a<template>x<template>y</template>z</template>b</p>", ["a b"]), ("<p>a</p><template><p>b</p>", ["a"]), ("<p>a</p></template>b", ["a", "b"]),
    ("<div>a<table><tr><td>b</div>c</td></tr></table>d</div>e", ["a", "b", "c", "d", "e"])])
def test_formulas_templates_and_stray_end_tags(source, texts):
    assert [t for t in dom.parse(source).texts if t] == texts


def test_a_stray_end_tag_stays_in_its_cell():
    page = dom.parse("<div><table><tr><td>b</div>c</td></tr></table>d</div>e")
    inside = {t: page.tags[page.parents[v]] for v, t in enumerate(page.texts) if t}
    assert inside == {"b": "td", "c": "td", "d": "div", "e": "html"}


@pytest.mark.parametrize("source", [
    "", "no markup", "<p", "<p>a<p>b", "<div><p>a</div>b</p>", "</div>" * 50 + "x", "<!-- open", "<script>var a = '<p>x</p>'", "<a b='>'>t</a>",
    "<div>" * 5000 + "deep" + "</div>" * 5000, "<p title=\"x>y", "<table><tr><td>a<td>b<tr><td>c</table>d", "&amp;&#228;&unknown; &nbsp; x", "<ul><li>a<ul><li>b</ul><li>c</ul>"])
def test_any_source_is_a_page(source):
    page = dom.parse(source)
    assert all(p < i for i, p in enumerate(page.parents))
    assert extraction.node_features(page).shape == (len(page.tags), extraction.FEATURES)


def test_blocks_and_references():
    texts = [t for t in dom.parse("<body><h1>A &amp;\n B</h1><p>one<br>two <b>th</b>ree<p>four<script>x()</script> five<!-- c --></body>").texts if t]
    assert texts == ["A & B", "one two three", "four five"]


@pytest.mark.parametrize("source, texts", [
    ("<p>a</p><!-- b", ["a"]), ("<p>a</p><!-- <p>b</p> c", ["a"]), ("<p>a<!--b-->c", ["ac"]), ("<p>a</p><script>b</p> c", ["a"]),
    ("<script>x</script>b <c", ["b <c"]), ("a < b <c", ["a < b <c"]), ("<p>a <b", ["a <b"]), ("a <!-- b <c", ["a"]), ("<!-->a", []),
    ("<p>x</p>" + "<a " * 400_000, ["x", " ".join(["<a"] * 400_000)])])
def test_ends_of_pages(source, texts):
    assert [t for t in dom.parse(source).texts if t] == texts


@pytest.mark.parametrize("source, texts", [
    *((f"<body><{name}></{name}><article><p>a</p></article>", ["a"]) for name in (
        "svg-icon", "video-js", "audio-player", "title-bar", "template-x", "object-view", "math-field")),
    ("<video-js><p>a</p></video-js>b", ["a", "b"]), ("<svg/><p>a</p>", ["a"]), ("<SVG />a", ["a"]), ("<p>a<math/>b</p>c", ["a b", "c"]),
    ("<svg viewBox='0 0 1 1' aria-label=\"x>y\" hidden/><p>a</p>", ["a"]), ("<svg a='/'><p>x</p></svg>b", ["b"]),
    ("<svg class=a/><p>x</p></svg>b", ["b"]), ("<svg><path/><p>x</p></svg>b", ["b"]), ("<svg\n/>a", ["a"]), ("<script/>x</script>b", ["b"]),
    ("a<svg/>", ["a"]), ("a<svg/>b <c", ["a b <c"]), ("a<svg>b <c", ["a"]), ("a<svg>b</p>", ["a"])])
def test_names_that_begin_like_raw_elements(source, texts):
    assert [t for t in dom.parse(source).texts if t] == texts


def test_features_in_blocks_are_the_same(monkeypatch):
    page = dom.parse("<div class='post'><p>one</p><ul><li>two</li></ul></div><footer>three <a>four</a></footer>" * 9)
    whole = extraction.node_features(page)
    assert (np.concatenate(list(extraction.node_blocks(page, 7))) == whole).all() and len(whole) == len(page.tags)
    y = np.array([float(t == "p") for t in page.tags])
    trees = extraction.boost(whole, y, 3)
    monkeypatch.setattr(extraction, "ROWS", 10)
    assert extraction.node_odds([page, page], trees) == [*trees.margins(whole)] * 2


def test_main_text_in_many_layouts():
    pool = [prose(i, 30) for i in range(30)]
    trees = extraction.learn([f"<article><p>{prose(i, 40)}</p><p>{prose(100 + i, 90)}</p></article>" for i in range(120)])
    rng = random.Random(77)
    right = wrong = missed = 0
    for i in range(80):
        page = dom.parse(extraction.layout(rng, [prose(500 + i + k, 40) for k in range(rng.randint(2, 6))], pool))
        y = extraction.truth(page)
        chosen = extraction.decode(page.parents, trees.margins(extraction.node_features(page)).tolist())
        for v, text in enumerate(page.texts):
            right += len(text) * (chosen[v] and y[v] > 0)
            wrong += len(text) * (chosen[v] and y[v] == 0)
            missed += len(text) * (not chosen[v] and y[v] > 0)
    assert right / (right + wrong) > 0.85 and right / (right + missed) > 0.9


def test_extraction_of_odd_rows(spark):
    trees = extraction.learn(["<article><p>some words of an article</p></article>"] * 3)
    pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p></p>"), (2, "u", "<p></p>")], "page_id long, url string, html string")
    rows = extraction.extract(pages, trees).collect()
    assert len(rows) == 4 and {(r["text"], r["n_chars"]) for r in rows} == {("", 0)}
    nothing = pages.where("false")
    assert extraction.extract(nothing, extraction.fit(nothing)).count() == 0


# 6 WARC


def test_archives_of_odd_pages(spark):
    big = "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 60 + "ä"
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999), (6, "u", "x" * 999),
            (2, None, big), (None, "u", big), (7, "u", "\r\n\r\n" * 400), (8, "", "\r\n\r\n" * 400)]
    pages = spark.createDataFrame([(*r, "c", "d") for r in rows], "page_id long, url string, html string, digest string, original string")
    found = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(pages).collect()]
    n = len(big.encode())
    assert sorted(found, key=str) == sorted([
        (1, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (None, n, "revisit", 2), (3, 0, "response", None),
        (4, 0, "response", None), (5, 999, "response", None), (6, 999, "response", None), (7, 1600, "revisit", 8), (8, 1600, "response", None)], key=str)
    assert warc.archive_and_read(pages.where("false")).count() == 0


def test_payloads_and_headers_come_back(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", prose(i % 3, 300)) for i in range(9)], "page_id long, url string, html string")
    folder = str(tmp_path / "archives")
    warc.write_archives(warc.resolved(pages), folder, records_per_file=2)
    rows = warc.read_archives(spark, folder, payloads=True).collect()
    assert {r["url"] for r in rows} == {f"http://h/{i}" for i in range(9)}
    responses = {r["page_id"]: r for r in rows if r["type"] == "response"}
    assert {int(k): r["payload"].decode() for k, r in responses.items()} == {i: prose(i % 3, 300) for i in (6, 7, 8)}
    assert len({r["record_id"] for r in rows}) == 9
    assert all(r["payload"] == b"" and r["refers_to_id"] in {x["record_id"] for x in responses.values()} for r in rows if r["type"] == "revisit")


def test_records_have_the_date_of_the_run(spark):
    pages = spark.createDataFrame([(i, "u", prose(0, 300)) for i in range(3)], "page_id long, url string, html string")

    def dates(date=None):
        records = [r["record"] for r in warc.as_records(warc.resolved(pages), date).collect()]
        return {line.split(": ")[1] for r in records for line in r.split("\r\n") if line.startswith(("WARC-Date", "WARC-Refers-To-Date"))}

    before, found, after = warc.now(), dates(), warc.now()
    assert len(found) == 1 and before <= found.pop() <= after
    assert dates("2020-02-02T00:00:00Z") == {"2020-02-02T00:00:00Z"}


# 7 packing


@pytest.mark.parametrize("seed", range(6))
def test_assignment_fills_every_sequence(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 1023) for _ in range(rng.randint(1, 400))]
    placed, rooms = covering(packing.assign(sizes), sizes), packing.capacities(sum(sizes), 1024)
    filled = [0] * len(rooms)
    for _, _, n, s, offset in placed:
        assert offset == filled[s]
        filled[s] += n
    assert filled == rooms
    costs = np.zeros(len(rooms))
    for _, _, n, s, _ in placed:
        costs[s] += packing.cost(n)
    full = costs[[r == 1024 for r in rooms]]
    assert not len(full) or full.max() <= 1.13 * full.min()  # one piece of 1024 costs 1.125 times its tokens


def covering(placed, sizes):
    """The pieces, after a check that they cover every document once."""
    covered = [0] * len(sizes)
    for d, start, n, _, _ in placed:
        assert start == covered[d]
        covered[d] += n
    assert covered == sizes
    return placed


def test_tokenizers_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(catalog.vocabulary_path())
    texts = ["", " ", "\n\n  x", "<|endoftext|> a", "a <|endoftext|><|endoftext|>  b <|endoftext", "it's we'll I'D", "äßあ\U0001f600́", "a" * 5000, "12 345,6  7\t8\r\n", "   x", "\u0000\u0001", "x \n y", prose(1, 500)]
    texts += ["".join(chr(c) + " 1"[c % 2] for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000) for at in range(0, 0x20000, 4096)]
    texts += [" " * 1_500_000, "x" + "\n" * 1_200_000 + "y", "z" * 400_000]
    assert [encode(t) for t in texts] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_of_odd_rows(odd, docs):
    rows = packing.pack(odd, catalog.vocabulary_path(), with_ids=True).collect()
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2, 6)] == [1, 1, 1]
    assert sum(r["length"] for r in rows if r["doc_id"] == 5) == 2 * rows_of(rows, 5)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    whole = sum(r["length"] for r in rows if r["doc_id"] == 7)
    assert whole == [r["doc_tokens"] for r in rows if r["doc_id"] == 7][0] > 60_000
    assert packing.pack(docs(), catalog.vocabulary_path()).count() == 0


def rows_of(rows, doc):
    return [r["doc_tokens"] for r in rows if r["doc_id"] == doc][0]


# 8 quality


def test_pairs_in_linear_time():
    machine = quality.Machine([b"one two three", b"four"], [None, 4], np.array([1.0, 0.0]))
    index, value, ends = machine._vectors(*quality.features([b"one two four five", b""], [17, None]))
    margin, _, _ = machine._margin(index, value, ends)
    for k in range(2):
        i, v = index[ends[k]:ends[k + 1]], value[ends[k]:ends[k + 1]]
        plain = machine.bias + (machine.weight[i] * v).sum()
        for a in range(len(i)):
            for b in range(a):
                plain += machine.factor[i[a]] @ machine.factor[i[b]] * v[a] * v[b]
        assert margin[k] == pytest.approx(plain)


def test_quality_of_odd_rows(odd, docs, spark):
    labels = spark.createDataFrame([(5, 1), (1, 0), (None, 1), (99, 1), (5, None)], "doc_id long, quality int")
    machine = quality.fit(odd, labels)
    rows = quality.with_score(odd, machine, "__score")
    assert rows.columns == [*odd.columns, "__score"]
    assert all(0 <= r["__score"] <= 1 for r in rows.collect()) and rows.count() == len(ODD) + 1
    blank = quality.fit(odd, labels.where("false"))
    assert [r["s"] for r in quality.with_score(docs((1, "a"), (2, None)), blank, "s").collect()] == pytest.approx([0.5, 0.5], abs=0.05)
    assert quality.with_score(docs(), machine, "s").count() == 0


# 9 chat


def told(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.format_conversations(frame)
    return {r["conv_id"]: r for r in found.select(
        "*", chat.read_turns().alias("turns"), chat.learned_text().alias("learned"), chat.formatted().alias("all")).collect()}


def test_escapes_come_back(spark):
    rng = random.Random(4)
    parts = [*chat.CHAT.controls(), "\\", "\\b", "\\c", "<", "s>", "[", "INST]", " ", "x", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    rows = [(i, t, "assistant" if t % 2 else "user", texts[(2 * i + t) % 300]) for i in range(150) for t in range(2)]
    for i, r in told(spark, rows).items():
        assert [t["text"] for t in r["turns"]] == [texts[(2 * i + t) % 300] for t in range(2)]
        assert r["learned"] == texts[(2 * i + 1) % 300]
        inside = [s["text"] for s in r["segments"] if s["kind"] == "text"]
        assert not any(c in s for s in inside for c in chat.CHAT.controls())


def test_turn_order(spark):
    rows = told(spark, [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "user", "b"), (3, 2, "assistant", "c"),
        (4, 5, "assistant", "z"), (4, 2, "user", "y"), (4, 1, "system", "x"), (5, 0, "user", "a"), (6, 0, "odd <s> role", None), (6, 1, None, "t"),
        (None, 0, "user", None), (7, 0, "user", "r"), (7, 0, "user", "r")])
    assert {i: (r["valid"], r["broken_at"]) for i, r in rows.items()} == {
        1: (True, None), 2: (False, 0), 3: (False, 1), 4: (True, None), 5: (False, None), 6: (False, 0), None: (False, None), 7: (False, 1)}
    assert [t["role"] for t in rows[4]["turns"]] == ["system", "user", "assistant"]
    assert [(t["role"], t["text"]) for t in rows[6]["turns"]] == [("odd <s> role", ""), ("", "t")]
    assert rows[1]["all"] == "<s>[INST] a [/INST][ANSWER] b</s>"
    assert told(spark, []) == {}


# 10 exact copies


def test_exact_groups_of_odd_rows(odd, docs):
    rows = [tuple(r) for r in exact.decide(odd).select("doc_id", "keep_id", "group_size", "kept").collect()]
    assert sorted(rows, key=str) == sorted([
        (1, 3, 4, False), (2, 3, 4, False), (3, 3, 4, True), (6, 3, 4, False), (4, 4, 1, True), (None, None, 1, True),
        (5, 5, 2, True), (5, 5, 2, True), (7, 7, 1, True)], key=str)
    kept = exact.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 7]
    assert exact.decide(docs()).count() == 0 and exact.deduplicate(docs()).count() == 0


def test_longest_copy_stays_then_smallest_id(docs):
    rows = docs((9, "a b"), (3, "ab"), (4, "a  b"), (5, "a b"), (2, "a\n\nb"), (None, "a  b"))
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact.decide(rows).collect()} == {
        (9, 2, False), (3, 2, False), (4, 2, False), (5, 5, True), (2, 2, True), (None, 2, False)}


@pytest.mark.parametrize("most", [1 << 10, 1 << 28])
def test_a_full_filter_changes_nothing(docs, monkeypatch, most):
    monkeypatch.setattr(exact, "MIN_BITS", 1 << 10)
    monkeypatch.setattr(exact, "MAX_BITS", most)
    rows = docs(*[(i, f"text {i % 700}") for i in range(1000)])
    found = exact.decide(rows).collect()
    assert {r["doc_id"]: r["keep_id"] for r in found} == {i: i % 700 for i in range(1000)}
    assert exact.deduplicate(rows).count() == 700


def test_the_filter_is_cut_into_slices(spark, monkeypatch):
    """16 bits a row at any number of rows: the share of suspects stays, the answers too."""
    rows = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") < 300, F.col("id") % 100).when(F.col("id") < 3300, 1).otherwise(F.col("id"))).alias("text"),
        F.lit("mine").alias("slice"), F.lit(1).alias("suspect"))

    def told():
        decided, kept = exact.decide(rows), exact.deduplicate(rows)
        assert kept.columns == rows.columns
        return sorted(map(tuple, decided.collect())), sorted(map(tuple, kept.collect()))

    whole = told()
    assert len(exact.slices(9000)) == 1 and len(whole[1]) == 5800
    monkeypatch.setattr(exact, "MIN_BITS", 1 << 13)
    monkeypatch.setattr(exact, "MAX_BITS", 1 << 13)
    ranges = exact.slices(9000)
    assert len(ranges) == 18 and ranges[0][0] == "00000000" and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert told() == whole

    def alone_but_suspect(n):
        distinct = rows.where("doc_id >= 3300").limit(n)
        marks = exact.marked(exact.fingerprints(distinct))
        return marks.where("suspect").count() / n

    few, many = alone_but_suspect(500), alone_but_suspect(5000)
    assert many < 0.05 and few < 0.05
    # One filter of that size for all rows would suspect nearly every one.
    monkeypatch.setattr(exact, "slices", lambda rows: [("0", "g")])
    assert alone_but_suspect(5000) > 0.3


def test_arrow_texts_of_null():
    from ledgerloom.llm.shared import texts_of

    assert texts_of(pa.array([None, "ä"])) == [b"", "ä".encode()]
