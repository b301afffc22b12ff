"""Block elements and text runs of a web page, as flat arrays in document order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Element names of the HTML standard.
BLOCKS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd menu table caption thead tbody "
    "tfoot tr td th form fieldset figure figcaption blockquote pre address details summary dialog center hr label select "
    "button search".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY_ITSELF = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot tr td th div section article body menu".split())
# What an end tag of another kind does not reach out of.
CELLS = frozenset("td th caption table".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
# Elements whose start ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"label", "button", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}

TOKEN = re.compile(
    r"<!--.*?(?:(?P<end>-->)|\Z)"
    # An svg element may close itself; a "/" that ends an unquoted value does not.
    r"|<(?P<empty>svg)(?=[\s/])(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+))?+)*+[\s/]*/>"
    r"|<(?P<raw>script|style|noscript|title|textarea|svg|annotation|annotation-xml|iframe|object|canvas|audio|video)(?=[\s/>])[^>]*+>.*?"
    r"(?:(?P<shut></(?P=raw)\s*+>)|\Z)"
    r"|<(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>"
    r"|<[!?][^>]*+>",
    re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""(?:\b(class|id|role|aria-label|itemprop)\s*=\s*)(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Nodes in document order: tag ('#text' for a run of text), parent, depth, attribute
    words, and for runs of text the text, its characters inside links and its links."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    words: list[frozenset[str]] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, words: frozenset[str] = frozenset(), text: str = "", linked: int = 0, links: int = 0) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.words.append(words)
        self.texts.append(text)
        self.linked.append(linked)
        self.links.append(links)
        return len(self.tags) - 1


def attribute_words(attributes: str) -> frozenset[str]:
    """Words of class, id and role names in lower case: "siteNav main-menu" gives site, nav, main, menu."""
    if "=" not in attributes:
        return frozenset()
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        found.update(w.lower() for w in PARTS.findall(m[2] or m[3] or m[4] or ""))
    return frozenset(found)


def parse(source: str) -> Page:
    """The page's blocks. Anything is a page: unclosed and misplaced tags are repaired the simple way."""
    page = Page()
    root = page.add("html", -1)
    stack: list[tuple[str, int]] = [("html", root)]
    open_count = {"html": 1}
    pieces: list[str] = []
    anchor, linked, links = 0, 0, 0

    def flush() -> None:
        nonlocal linked, links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                page.add("#text", stack[-1][1], frozenset(), text, linked, links)
            pieces.clear()
        linked = links = 0

    def pop_to(tag: str) -> None:
        while stack[-1][0] != tag:
            open_count[stack.pop()[0]] -= 1
        open_count[stack.pop()[0]] -= 1

    def put(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if anchor:
            linked += len(text)

    # No tag begins after the last ">", so it is not sought there: "<" in a long rest would cost its square.
    last, cut = source.rfind(">") + 1, False
    at = hidden = 0  # templates may hold templates
    for m in TOKEN.finditer(source, 0, last):
        if m.start() > at and not hidden:
            put(source[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            if m["raw"] or m["empty"]:
                pieces.append(" ")
            # What is never closed goes on to the end of the page.
            cut = at == last and not (m["end"] or m["shut"]) and (bool(m["raw"]) or m[0].startswith("<!--"))
            continue
        tag = name.lower()
        if tag == "template":
            hidden = max(0, hidden - 1 if m["slash"] else hidden + 1)
            pieces.append(" ")
        if hidden:
            continue
        if tag not in BLOCKS:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                anchor = 0 if m["slash"] else 1
                links += not m["slash"]
            elif tag in ("input", "img"):
                pieces.append(" ")
            continue
        flush()
        if m["slash"]:
            if tag != "html" and open_count.get(tag):
                # An end tag does not reach out of the table cell it stands in, nor that of an item or paragraph out of its list or article.
                for known, _ in reversed(stack):
                    if known == tag:
                        pop_to(tag)
                        break
                    if known in CELLS and tag not in TABLE_PARTS or tag in ("p", "li", "dt", "dd") and known in HOLDERS:
                        break
            anchor = 0
            continue
        words = attribute_words(m["attributes"])
        if tag in ("html", "body"):
            if tag == "html" or open_count.get("body"):
                page.words[stack[0][1]] |= words if tag == "html" else frozenset()
                continue
        if tag in ENDS_PARAGRAPH and open_count.get("p"):
            for known, _ in reversed(stack):
                if known == "p":
                    pop_to("p")
                    break
                if known in HOLDERS:
                    break
        for other in CLOSED_BY_ITSELF.get(tag, ()):
            if stack[-1][0] == other:
                pop_to(other)
        if tag in VOID:
            continue
        stack.append((tag, page.add(tag, stack[-1][1], words)))
        open_count[tag] = open_count.get(tag, 0) + 1
        anchor = 0
    if not cut and not hidden:
        put(source[at:last])
        put(source[last:].partition("<!--")[0])
    flush()
    return page
