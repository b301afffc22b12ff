"""Quality rules whose cutoffs come from the data: fences from quantile sketches per language and source.

Fixed rules on counts of a text come first: too few words, or too many of them in repeated windows. The other rules compare a text with its
own kind. Each metric (a whole number: a share in millionths, or a mean in thousandths) is summarised by a quantile sketch per language and
source. A sketch is a table of counts by bucket; a bucket holds the values that agree in their leading SKETCH_BITS bits, so a quantile is at most 1/64 too
low, and sketches merge by adding counts: in any order, on the map side, without chance. Merging the sources' sketches gives the language's, and
merging those the corpus's. A language and source with fewer than LEAST texts takes the next larger group's fences; the corpus's own count is not asked for.

Fences are the quartiles, moved out by REACH times their distance, at least by the rule's least reach, so that quartiles that agree (most texts have no symbols) do
not fence out every other text. Texts meet their group's fences in a join that deals a group with very many texts to pieces.

Defined results: null text has no words; null languages and sources are groups of their own; repeated rows count and are kept each; a text
that fails the fixed rules is in no sketch; no rows give no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.encoded import BLANKS, encode, encode_lines, places_of
from ledgerloom.llm.shared import runs, texts_of
from ledgerloom.plans.skew import lookup_join
from ledgerloom.plans.workspace import run_folder

SYMBOLS = b"#*$%&|<>"
FEWEST_WORDS, MOST_REPEATED, WIDTH = 50, 50, 3
SKETCH_BITS, LEAST, REACH = 7, 100, 6
CHUNK = 4 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A metric in whole numbers, and how far from the quartiles its fences are at least."""

    name: str
    over: str
    under: str
    scale: int
    least: int
    both: bool = False

    def value(self) -> Column:
        return F.expr(f"{self.scale} * {self.over} div greatest({self.under}, 1)")


RULES = (
    Rule("symbols", "n_symbols", "word_chars", 1_000_000, 30_000),
    Rule("word_length", "word_chars", "n_words", 1_000, 1_500, both=True),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1_000_000, 500_000),
    Rule("repeats", "n_repeat_words", "n_words", 1_000_000, 400_000),
)


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(texts: list[bytes]) -> np.ndarray:
    """A row of COUNTS for each text."""
    n, words = len(texts), encode(texts)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    inside = places_of(data, BLANKS)
    chars = _per_text(inside & ((data & 0xC0) != 0x80), bounds)
    symbols = _per_text(~places_of(data, SYMBOLS), bounds)
    at, number, distinct = words.runs(WIDTH)[-1]
    place = words.text_of[at] * max(1, distinct) + number  # a window of its text
    _, own, often = np.unique(place, return_inverse=True, return_counts=True)
    again, covered = at[often[own] > 1], np.zeros(len(words.ids), dtype=bool)
    for j in range(WIDTH):
        covered[again + j] = True
    lines = encode_lines(texts)
    spoken = np.array([bool(v.split()) for v in lines.vocabulary.to_pylist()], dtype=bool)[lines.ids]
    text, line = lines.text_of[spoken], lines.ids[spoken]
    size = max(1, len(lines.vocabulary))
    n_lines, first = np.bincount(text, minlength=n), np.unique(text * size + line) // size
    return np.stack([
        np.bincount(words.text_of, minlength=n), chars, symbols, n_lines, n_lines - np.bincount(first, minlength=n),
        np.bincount(words.text_of[covered], minlength=n)], axis=1).astype(np.int64)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for a, b in runs(texts, CHUNK):
            found, rest = measure(texts[a:b]), batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [*[rest.column(c) for c in ("doc_id", "lang", "source")], *[pa.array(c) for c in found.T]], ["doc_id", "lang", "source", *COUNTS])


def measured(docs: DataFrame) -> DataFrame:
    """Each text's counts and whether it fails the fixed rules."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    rows = docs.select("doc_id", "lang", "source", "text").mapInArrow(_measured, ", ".join(
        [*[f"{c} {kinds[c]}" for c in ("doc_id", "lang", "source")], *[f"{c} long" for c in COUNTS]]))
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def bucket(value: Column) -> Column:
    """The least value of the sketch's bucket: all but the leading SKETCH_BITS bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, rule, low, n: the sketch of each metric of the texts that pass the fixed rules."""
    values = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), bucket(r.value()).alias("low")) for r in RULES]))
    return (rows.where(~F.col("base_failed")).select("lang", "source", values.alias("v"))
            .groupBy("lang", "source", "v.rule", "v.low").agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its texts, and the quartiles of every metric. A sketch has at most some thousand buckets."""
    merged = sketch.groupBy(*keys, "rule", "low").agg(F.sum("n").alias("n"))
    pairs = merged.groupBy(*keys, "rule").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("low", "n"))).alias("pairs"))

    def quartile(quarters: int) -> Column:
        # The first bucket up to which at least that many quarters of the texts lie.
        return F.aggregate("pairs", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")), lambda held, p: F.struct(
            (held["seen"] + p["n"]).alias("seen"),
            F.when(held["at"].isNull() & (4 * (held["seen"] + p["n"]) >= quarters * F.col("size")), p["low"]).otherwise(held["at"]).alias("at")))["at"]

    found = pairs.select(*keys, "rule", "size", quartile(1).alias("q1"), quartile(3).alias("q3"))
    return found.groupBy(*keys).agg(F.max("size").alias("size"), *[
        F.max(F.when(F.col("rule") == r.name, F.struct("q1", "q3"))).alias(r.name) for r in RULES])


def fences(sketch: DataFrame) -> DataFrame:
    """lang, source and the bounds of every rule, from the smallest group with LEAST texts that holds the source."""
    own = quartiles(sketch, ["lang", "source"])
    # Languages and the corpus are merged from the sources' sketches.
    names = [r.name for r in RULES]
    by_lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("__lang"), F.col("size").alias("__size"), *[F.col(n).alias(f"__{n}") for n in names])
    whole = quartiles(sketch, []).select(*[F.col(n).alias(f"__all_{n}") for n in names])
    rows = lookup_join(own, by_lang.withColumnRenamed("__lang", "lang"), ["lang"], ["source"], nulls_match=True)
    rows = rows.join(F.broadcast(whole))  # one row
    out = []
    for r in RULES:
        best = F.when(F.col("size") >= LEAST, F.col(r.name)).when(F.col("__size") >= LEAST, F.col(f"__{r.name}")).otherwise(F.col(f"__all_{r.name}"))
        reach = F.greatest(REACH * (best["q3"] - best["q1"]), F.lit(r.least))
        out.append((best["q3"] + reach).alias(f"most_{r.name}"))
        if r.both:
            out.append((best["q1"] - reach).alias(f"least_{r.name}"))
    return rows.select("lang", "source", *out)


def judge(docs: DataFrame) -> DataFrame:
    """Each row's counts, base_failed and kept. Counts and fences are written below the shared folder, so every text is measured once."""
    spark, folder = docs.sparkSession, run_folder(docs.sparkSession, "rules")
    measured(docs).write.parquet(f"{folder}/measured")
    rows = spark.read.parquet(f"{folder}/measured")
    sketches(rows).write.parquet(f"{folder}/sketches")
    fences(spark.read.parquet(f"{folder}/sketches")).write.parquet(f"{folder}/fences")
    kept = ~F.col("base_failed")
    for r in RULES:
        kept = kept & (r.value() <= F.col(f"most_{r.name}"))
        if r.both:
            kept = kept & (r.value() >= F.col(f"least_{r.name}"))
    counts = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_rows"))
    found = lookup_join(rows, spark.read.parquet(f"{folder}/fences"), ["lang", "source"], ["doc_id", *COUNTS], counts=counts, nulls_match=True)
    # A group without fences has only texts that fail the fixed rules.
    return found.select("doc_id", *COUNTS, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"))
