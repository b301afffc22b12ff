"""Benchmark decontamination: short test items found inside long documents.

Items are put into partitions by size (powers of two of their number of distinct
shingles). Every item of a partition is sketched by its bottom-k MinHash values. With
threshold t and n shingles, a document that contains the item lacks at most n - ceil(t n)
of its shingles, so it holds at least one of any n - ceil(t n) + 1 of them: k is that number
for the partition's upper size, and the search misses nothing. A document's own sketch
is the set of its shingle hashes up to the largest value in any item's sketch. Where both
sketches meet, the item's and the document's shingles are compared as text.

Words are those of `words.py` in texts that `normal` rewrites first: in Unicode's case-folded compatibility form (NFKC), with a blank
for every character that is no letter, mark or digit, and blanks around every character of scripts that put none between words. So case,
punctuation and typography do not matter; invisible characters inside words (soft hyphens, joiners) are left out. Documents are
never shuffled. Items go to the tasks in blocks of bounded size; a larger benchmark makes
more blocks, each one pass over the documents.

Defined results: a null or wordless item or document matches nothing; an item with fewer
words than a shingle is searched with shingles of its own number of words, so it is found wherever they stand one after the other; repeated items count once;
several rows with one id are searched one by one, and a pair's row is the best of them; a null id stays null.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import runs, texts_of
from ledgerloom.llm.words import Words, find_words, plain_shingles, shingles

WIDTH, THRESHOLD = 5, 0.8
BLOCK_BYTES = 32 << 20


# Scripts without blanks between words, by their names in Unicode.
UNSPACED = ("CJK ", "HIRAGANA ", "KATAKANA ", "THAI ", "LAO ", "KHMER ", "MYANMAR ", "TIBETAN ", "YI ", "BOPOMOFO ", "TAI ", "NEW TAI ", "JAVANESE ", "BALINESE ")
BEYOND_ASCII = re.compile(r"[^\x00-\x7f]+")


class Rewritten(dict):
    """What becomes of each character beyond ASCII, found when first met."""

    def __init__(self, unspaced: tuple[str, ...] = ()) -> None:
        self.unspaced = unspaced

    def __missing__(self, code: int) -> str:
        char = chr(code)
        kind, name = unicodedata.category(char), unicodedata.name(char, "")
        if code == 0x200B or kind[0] not in "LNMC" or name.startswith("MODIFIER LETTER") and "APOSTROPHE" in name:
            self[code] = " "
        elif kind == "Cf":
            self[code] = ""
        elif kind[0] == "C":
            self[code] = " "
        else:
            self[code] = f" {char} " if self.unspaced and name.startswith(self.unspaced) else char
        return self[code]


LEVELLED, SPACED = Rewritten(), Rewritten(UNSPACED)


def rewritten(text: str, table: Rewritten) -> str:
    return BEYOND_ASCII.sub(lambda m: m[0].translate(table), text)


def normal(text: bytes) -> bytes:
    """The text with case, typography and punctuation beyond ASCII levelled, for the words of `words.py`. Before the
    compatibility form, too, marks are made blanks: some would become letters or accents."""
    if text.isascii():
        return text
    plain = unicodedata.normalize("NFKC", rewritten(text.decode(errors="replace"), LEVELLED)).casefold()
    return rewritten(unicodedata.normalize("NFKC", plain), SPACED).encode()


class Group:
    """Sketches of the items that are searched with shingles of one width."""

    def __init__(self, texts: list[bytes], places: list[int], width: int, threshold: float) -> None:
        self.width, self.threshold = width, threshold
        hashes, owners = shingles(find_words([texts[i] for i in places]), width)
        bounds = np.searchsorted(owners, np.arange(len(places) + 1))  # the owners ascend
        self.items: dict[int, set[bytes]] = {}
        sketch, owner = [], []
        for n, i in enumerate(places):
            own = np.unique(hashes[bounds[n]:bounds[n + 1]])
            upper = 1 << (len(own) - 1).bit_length()
            k = upper - math.ceil(threshold * upper - 1e-9) + 1
            sketch.append(own[:k])
            owner.append(np.full(len(sketch[-1]), i))
            self.items[i] = plain_shingles(texts[i], width)
        self.sketch, self.owner = np.concatenate(sketch), np.concatenate(owner)
        order = np.argsort(self.sketch, kind="stable")
        self.sketch, self.owner = self.sketch[order], self.owner[order]
        self.values = np.unique(self.sketch)

    def matches(self, texts: list[bytes], words: Words) -> Iterator[tuple[int, int, int]]:
        hashes, text = shingles(words, self.width)
        low = hashes <= self.values[-1]
        hashes, text = hashes[low], text[low]
        at = np.searchsorted(self.values, hashes)
        hit = self.values[at] == hashes
        if not hit.any():
            return
        hits = np.unique(np.stack([text[hit], at[hit]]), axis=1)
        for t in np.unique(hits[0]):
            found = self.values[hits[1][hits[0] == t]]
            begin, end = np.searchsorted(self.sketch, found), np.searchsorted(self.sketch, found, side="right")
            candidates = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(begin, end, strict=True)]))
            own = plain_shingles(texts[t], self.width)
            for i in candidates.tolist():
                shared = len(self.items[i] & own)
                if shared >= self.threshold * len(self.items[i]) - 1e-9:
                    yield int(t), i, shared


class Block:
    """A bounded set of items with their sketches, by width: an item shorter than a shingle has its own number of words as width."""

    def __init__(self, ids: pa.Array, texts: list[bytes], width: int, threshold: float) -> None:
        texts = [normal(t) for t in texts]
        by_width: dict[int, list[int]] = {}
        for i, n in enumerate(find_words(texts).counts().tolist()):
            if n:
                by_width.setdefault(min(n, width), []).append(i)
        self.ids = ids
        self.groups = [Group(texts, places, w, threshold) for w, places in sorted(by_width.items())]
        self.items = {i: item for g in self.groups for i, item in g.items.items()}

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of every pair that meets the threshold."""
        if not self.groups:
            return
        texts = [normal(t) for t in texts]
        words = find_words(texts)
        for group in self.groups:
            yield from group.matches(texts, words)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, threshold: float) -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK_BYTES of text, one after the other on the driver."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = 1 + size // BLOCK_BYTES
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part).orderBy("id", "text").toArrow()
        ids = rows.column("id").combine_chunks()
        yield Block(ids, texts_of(rows.column("text")), width, threshold)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document and item it contains: ids, shared and all shingles of the item, containment."""
    spark, found = docs.sparkSession, None
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = dict(benchmark.dtypes)
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, item_id {kinds[item_id]}, shared int, item_shingles int"
    for block in _blocks(benchmark, item_id, item_text, width, threshold):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                texts, pairs = texts_of(batch.column(1)), []
                for a, b in runs(texts):
                    pairs += [(t + a, i, n) for t, i, n in block.matches(texts[a:b])]
                at = pa.array([p[0] for p in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), block.ids.take(pa.array([p[1] for p in pairs], pa.int64())),
                    pa.array([p[2] for p in pairs], pa.int32()),
                    pa.array([len(block.items[p[1]]) for p in pairs], pa.int32()),
                ], names=["doc_id", "item_id", "shared", "item_shingles"])

        part = rows.mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    ratio = F.col("shared") / F.col("item_shingles")
    return (found.withColumn("containment", ratio).groupBy("doc_id", "item_id")
            .agg(F.max("containment").alias("containment")))


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents that contain no item, with their columns as they are."""
    spark, at = docs.sparkSession, docs.columns.index(text)
    for block in _blocks(benchmark, item_id, item_text, width, threshold):
        shared = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, keep = texts_of(batch.column(at)), np.ones(batch.num_rows, dtype=bool)
                for a, b in runs(texts):
                    for t, _, _ in shared.value.matches(texts[a:b]):
                        keep[a + t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
