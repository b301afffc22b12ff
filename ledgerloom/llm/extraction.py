"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Nodes are block elements and runs of text. A node's features are the density of text, links and marks in its subtree, the words
of its class, id and role names and of its ancestors' (hashed to WORD_BUCKETS), its tag and its ancestors' tags, its depth, its place among its siblings
and their sizes. The trees give each node the log odds of holding main text. Decoding finds the most likely choice in which a node
that is left out has no chosen descendant, and a node that is chosen has chosen text: bottom up, a subtree is worth its odds plus what its children are worth (of
which it needs one), or nothing; top down, what is worth something stays.

Fitting needs pages whose main text is known. They are laid out here from the texts of at most about SAMPLE pages, with
menus, headers, sidebars, notices, adverts, forms, comments and footers around an article, in containers with
speaking tags, with speaking class names, or both; for that, and only there, texts are cut to many lengths. Extraction reads every whole page.

Defined results: null or empty html, and pages without text, give the empty text; broken markup is repaired; rows are
extracted one by one.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.dom import Page, parse
from ledgerloom.llm.shared import share_below

SAMPLE, TREES, DEPTH, RATE, BINS, WORD_BUCKETS = 400, 80, 4, 0.3, 24, 96
TAGS = ("#text body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd menu table "
        "tr td th form fieldset figure figcaption blockquote pre address details dialog label button").split()
TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
PLAIN = 20
FEATURES = PLAIN + 2 * len(TAGS) + 2 * WORD_BUCKETS
ROWS = 1 << 14
MARKS = str.maketrans({c: "\0" for c in ".,;:!?"})


@lru_cache(maxsize=1 << 16)
def bucket(word: str) -> int:
    return crc32(word.encode()) % WORD_BUCKETS


def node_features(page: Page) -> np.ndarray:
    """One row per node."""
    return np.concatenate(list(node_blocks(page)))


def node_blocks(page: Page, most: int = ROWS) -> Iterator[np.ndarray]:
    """One row per node, in blocks of at most `most` rows, so a page of any length takes bounded memory."""
    n = len(page.tags)
    parents = page.parents
    chars, linked, links, marks, runs = ([0] * n for _ in range(5))
    nodes, kids, place, deep = [1] * n, [0] * n, [0] * n, [0] * n
    before = [0] * n
    seen = 0
    for v in range(n):
        before[v] = seen
        text = page.texts[v]
        if text:
            chars[v], linked[v], links[v], runs[v] = len(text), page.linked[v], page.links[v], 1
            marks[v] = text.translate(MARKS).count("\0")
            seen += len(text)
        p = parents[v]
        if p >= 0:
            place[v] = kids[p]
            kids[p] += 1
    for v in range(n - 1, 0, -1):
        p = parents[v]
        chars[p] += chars[v]
        linked[p] += linked[v]
        links[p] += links[v]
        marks[p] += marks[v]
        runs[p] += runs[v]
        nodes[p] += nodes[v]
        deep[p] = max(deep[p], deep[v] + 1)
    total = max(1, chars[0])
    up_tags = np.zeros((n, len(TAGS)), dtype=bool)
    up_words = np.zeros((n, WORD_BUCKETS), dtype=bool)
    x = np.zeros((min(most, n), FEATURES), dtype=np.float32)
    for v in range(n):
        if v and v % most == 0:
            yield _with_ancestors(x, up_tags[v - most:v], up_words[v - most:v])
            x = np.zeros((min(most, n - v), FEATURES), dtype=np.float32)
        p = parents[v]
        row = x[v % most]
        c = chars[v]
        pc = chars[p] if p >= 0 else c
        row[:PLAIN] = (
            c, c / total, linked[v] / (c + 1), links[v], marks[v] / (c + 1), c / nodes[v], runs[v], nodes[v], kids[v], deep[v],
            page.depths[v], place[v], kids[p] if p >= 0 else 1, c / (pc + 1), pc, linked[p] / (pc + 1) if p >= 0 else 0,
            marks[p] / (pc + 1) if p >= 0 else 0, before[v] / total, pc / (nodes[p] if p >= 0 else 1), pc / total)
        tag = TAG_NUMBER.get(page.tags[v], -1)
        if tag >= 0:
            row[PLAIN + tag] = 1
        if p >= 0:
            up_tags[v], up_words[v] = up_tags[p], up_words[p]
            tag = TAG_NUMBER.get(page.tags[p], -1)
            if tag >= 0:
                up_tags[v, tag] = True
            for w in page.words[p]:
                up_words[v, bucket(w)] = True
        for w in page.words[v]:
            row[PLAIN + 2 * len(TAGS) + bucket(w)] = 1
    yield _with_ancestors(x, up_tags[n - len(x):], up_words[n - len(x):])


def _with_ancestors(x: np.ndarray, up_tags: np.ndarray, up_words: np.ndarray) -> np.ndarray:
    x[:, PLAIN + len(TAGS):PLAIN + 2 * len(TAGS)] = up_tags
    x[:, PLAIN + 2 * len(TAGS) + WORD_BUCKETS:] = up_words
    return x


@dataclass
class Boosted:
    """Full binary trees of one depth on the logistic loss, grown on binned features."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
    """Splits of the plain features are sought among quantiles, those of yes-no features by one matrix product."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(PLAIN)]
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    flags = np.ascontiguousarray(x[:, PLAIN:])
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    margin, rows = np.full(len(y), base), np.arange(len(y))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            here = at - first
            sums_g, sums_h = np.bincount(here, g, width), np.bincount(here, h, width)

            def gain(left_g: np.ndarray, left_h: np.ndarray, sums_g=sums_g[:, None], sums_h=sums_h[:, None]) -> np.ndarray:
                return left_g**2 / (left_h + 1) + (sums_g - left_g)**2 / (sums_h - left_h + 1) - sums_g**2 / (sums_h + 1)

            weights = np.zeros((2 * width, len(y)), dtype=np.float32)
            weights[here, rows], weights[width + here, rows] = g, h
            ones = (weights @ flags).astype(float)
            gains = [gain(ones[:width], ones[width:])]
            cuts = [np.full(gains[0].shape, 0.5)]
            for j, e in enumerate(edges):
                if len(e):
                    size = len(e) + 1
                    key = here * size + binned[j]
                    left = [np.cumsum(np.bincount(key, w, width * size).reshape(width, size), axis=1)[:, :-1] for w in (g, h)]
                    gains.append(gain(*left))
                    cuts.append(np.broadcast_to(e, gains[-1].shape))
            number = np.concatenate([np.arange(PLAIN, x.shape[1]), *(np.full(len(e), j) for j, e in enumerate(edges))])
            gains, cuts = np.concatenate(gains, axis=1), np.concatenate(cuts, axis=1)
            best = gains.argmax(axis=1)
            useful = gains[np.arange(width), best] > 1e-9
            feature[first:first + width] = np.where(useful, number[best], 0)
            threshold[first:first + width] = np.where(useful, cuts[np.arange(width), best], np.inf)
            at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        leaf = at - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Boosted(np.array(features), np.array(thresholds), np.array(values), base)


def decode(parents: list[int], odds: list[float], holds: list[bool] | None = None) -> list[bool]:
    """The most likely choice in which every chosen node's parent is chosen; the root always is. With `holds` (does the node have text of
    its own?) every other chosen node without any must have a chosen child too: what is said to hold main text holds some."""
    n, none = len(parents), float("-inf")
    gains, best, child = [0.0] * n, [none] * n, [-1] * n  # of the children: what they add, and the best of them
    worth = [none] * n
    for v in range(n - 1, -1, -1):
        if holds is None or holds[v] or gains[v] > 0:
            worth[v] = odds[v] + gains[v]
        else:
            worth[v] = odds[v] + best[v]
        p = parents[v]
        if p >= 0:
            gains[p] += max(0.0, worth[v])
            if worth[v] >= best[p]:
                best[p], child[p] = worth[v], v
    chosen = [True] * n
    for v in range(1, n):
        p = parents[v]
        only = holds is not None and p > 0 and not holds[p] and gains[p] <= 0 and child[p] == v
        chosen[v] = chosen[p] and (worth[v] > 0 or only)
    return chosen


def node_odds(pages: list[Page], trees: Boosted) -> list[float]:
    """The log odds of all nodes of the pages in order, worked out for about ROWS nodes at a time."""
    out: list[float] = []
    held: list[np.ndarray] = []
    for page in pages:
        for block in node_blocks(page):
            held.append(block)
            if sum(map(len, held)) >= ROWS:
                out += trees.margins(np.concatenate(held)).tolist()
                held.clear()
    return out + (trees.margins(np.concatenate(held)).tolist() if held else [])


def main_text(page: Page, odds: list[float]) -> str:
    chosen = decode(page.parents, odds, [bool(t) for t in page.texts])
    return " ".join(t for t, c in zip(page.texts, chosen, strict=True) if t and c)


# Layouts for fitting: containers by kind, as (tag, class or id names).
SURROUNDINGS = {
    "menu": [("nav", ""), ("nav", "main-nav"), ("div", "nav"), ("div", "navbar"), ("div", "menu"), ("ul", "menu"), ("div", "breadcrumb"), ("div", "topnav"), ("div", "navigation"), ("menu", "")],
    "header": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site-header"), ("header", "page-header"), ("div", "topbar")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "site-footer"), ("footer", "page-footer"), ("div", "copyright"), ("div", "bottom")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("aside", "sidebar"), ("div", "related"), ("div", "widget"), ("div", "recommended"), ("section", "side"), ("div", "more")],
    "notice": [("div", "cookie"), ("div", "cookie-notice"), ("div", "notice"), ("div", "banner"), ("div", "consent"), ("div", "newsletter"), ("div", "popup"), ("dialog", ""), ("div", "alert"), ("section", "subscribe")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "sponsored"), ("aside", "promo"), ("div", "sponsor"), ("ins", "adsbygoogle")],
    "form": [("form", ""), ("form", "search"), ("div", "search-form"), ("form", "login"), ("fieldset", "")],
    "comments": [("div", "comments"), ("section", "comments"), ("div", "comment"), ("section", "discussion"), ("div", "replies"), ("ol", "commentlist"), ("div", "responses")],
    "share": [("div", "share"), ("div", "social"), ("ul", "social"), ("div", "tags"), ("p", "byline"), ("div", "meta")],
}
MAIN = [("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article"), ("div", "post"), ("div", "entry"),
        ("div", "story"), ("section", "article-body"), ("div", "text"), ("div", "main-content"), ("article", "hentry"), ("div", "")]


def layout(rng: random.Random, paragraphs: list[str], other: list[str]) -> str:
    """A page with the paragraphs as main text, each wrapped in marks \\1 ... \\2 that say so."""
    def words(low: int, high: int) -> str:
        pool = rng.choice(other).split() or ["x"]
        at = rng.randrange(len(pool))
        return " ".join((pool[at:] + pool)[:rng.randint(low, high)])

    def opened(tag: str, names: str) -> str:
        if not names:
            return f"<{tag}>"
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{names}">'

    def around(kind: str) -> str:
        tag, names = rng.choice(SURROUNDINGS[kind])
        tag = "div" if tag == "ins" else tag
        if kind in ("menu", "share"):
            items = [f'<a href="/{i}">{words(1, 3)}</a>' for i in range(rng.randint(2, 10))]
            inside = " ".join(items) if rng.random() < 0.3 else "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
            if tag == "ul":
                inside = "".join(f"<li>{i}</li>" for i in items)
            if tag == "p":
                inside = words(2, 6)
        elif kind == "form":
            inside = f"<label>{words(1, 3)}</label><input name=q><button>{words(1, 2)}</button>" + (f"<p>{words(3, 12)}</p>" if rng.random() < 0.4 else "")
        elif kind == "comments":
            inside = "".join(f'<div class="{rng.choice(["comment", "reply", "comment-body", ""])}"><p>{words(4, 60)}</p></div>' for _ in range(rng.randint(1, 5)))
            inside = (f"<h3>{words(1, 2)}</h3>" if rng.random() < 0.5 else "") + inside
        elif kind == "sidebar":
            inside = "".join(rng.choice([f'<p><a href="#">{words(3, 9)}</a></p>', f"<h3>{words(1, 4)}</h3>", f"<p>{words(5, 40)}</p>", f'<li><a href="#">{words(2, 8)}</a></li>']) for _ in range(rng.randint(1, 5)))
        else:
            text = words(2, 14) if kind != "notice" else words(4, 30)
            inside = text if rng.random() < 0.5 else f"<p>{text}</p>"
            if rng.random() < 0.4:
                inside += f' <a href="#">{words(1, 3)}</a>'
            if kind == "header" and rng.random() < 0.5:
                inside = f"<h1>{words(1, 4)}</h1>" + around("menu")
            if kind == "footer" and rng.random() < 0.5:
                inside = f"&copy; {inside} &middot; {words(1, 5)}"
        return f"{opened(tag, names)}{inside}</{tag}>"

    def body() -> str:
        out = []
        for i, p in enumerate(paragraphs):
            kind = rng.random()
            tag = "h1" if i == 0 and kind < 0.8 else "h2" if kind < 0.1 else "li" if kind < 0.16 else "blockquote" if kind < 0.2 else "p"
            marked = f"\1{p}\2"
            if tag == "li":
                marked = f"<ul><li>{marked}</li></ul>"
            elif rng.random() < 0.15:
                marked = f"<{tag}><b>{marked}<br>" if tag == "p" else f"<{tag}><b>{marked}</b></{tag}>"
            else:
                marked = f"<{tag}>{marked}</{tag}>"
            if rng.random() < 0.06:
                marked = f"<div>{marked}</div>"
            out.append(marked)
        for kind in ("advert", "share", "comments", "sidebar", "notice"):
            if rng.random() < 0.12:
                out.insert(rng.randint(0, len(out)) if kind != "comments" else len(out), around(kind))
        return "".join(out)

    tag, names = rng.choice(MAIN)
    article = f"{opened(tag, names)}{body()}</{tag}>"
    for _ in range(rng.choice((0, 0, 1, 2))):
        tag, names = rng.choice((("div", "wrapper"), ("div", "container"), ("main", ""), ("div", "page"), ("section", ""), ("div", "")))
        parts = [article] + [around(k) for k in ("sidebar", "comments") if rng.random() < 0.3]
        article = f"{opened(tag, names)}{''.join(parts)}</{tag}>"
    above = [around(k) for k in ("menu", "header", "advert", "notice", "form", "menu") if rng.random() < 0.5]
    below = [around(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice", "footer", "footer") if rng.random() < 0.45]
    rng.shuffle(above)
    return f"<html><head><title>{words(2, 8)}</title></head><body>{''.join(above)}{article}{''.join(below)}</body></html>"


def truth(page: Page) -> np.ndarray:
    """Whether each node of a laid out page holds main text; takes the marks away."""
    y = np.zeros(len(page.tags))
    for v, text in enumerate(page.texts):
        if "\1" in text or "\2" in text:
            y[v] = 1
            page.texts[v] = text.replace("\1", "").replace("\2", "").strip()
    for v in range(len(y) - 1, 0, -1):
        y[page.parents[v]] = max(y[v], y[page.parents[v]])
    return y


def learn(sources: list[str]) -> Boosted:
    """Trees from pages laid out with the texts of these pages."""
    rng = random.Random(5)
    texts = [[t.replace("\1", "").replace("\2", "").replace("<", "&lt;") for t in parse(s).texts if t] for s in sources]
    texts = [t for t in texts if t] or [["some words of a page, and more"]]
    pool = [t for ts in texts for t in ts]
    xs, ys = [], []
    for ts in texts:
        long = [t for t in ts if len(t) > 40] or ts
        for _ in range(2):
            # Main texts of few and many paragraphs, short ones among them.
            own = [rng.choice(long)[:rng.choice((5, 12, 30, 80, 200, 600, 2000))] for _ in range(rng.choice((1, 2, 4, 8, 16)))]
            if rng.random() < 0.5:
                # A short paragraph closes the article, however long the others are.
                own.append(rng.choice(pool)[:rng.choice((4, 8, 16, 24, 40))])
            page = parse(layout(rng, own if rng.random() < 0.6 else ts[:40], pool))
            ys.append(truth(page))
            xs.append(node_features(page))
    return boost(np.concatenate(xs), np.concatenate(ys))


def fit(pages: DataFrame, page_id: str = "page_id", html: str = "html", sample: int = SAMPLE) -> Boosted:
    """Trees fitted on the texts of about `sample` pages, chosen by a hash of the id."""
    total = pages.count()
    rows = pages.where(share_below(page_id, min(1.0, sample / max(1, total)))).where(F.col(html).isNotNull())
    return learn([r[html] for r in rows.orderBy(F.xxhash64(page_id), page_id, html).select(html).collect()])


def extract(pages: DataFrame, trees: Boosted, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for at in range(0, batch.num_rows, 64):
                parsed = [parse(h or "") for h in batch.column(2).slice(at, 64).to_pylist()]
                odds, begin = node_odds(parsed, shared.value), 0
                for p in parsed:
                    texts.append(main_text(p, odds[begin:begin + len(p.tags)]))
                    begin += len(p.tags)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, f"page_id {dict(pages.dtypes)[page_id]}, url string, text string, n_chars long")
