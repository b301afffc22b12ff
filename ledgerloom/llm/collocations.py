"""Phrase collocations of each language, by partitioning the corpus (SON).

The corpus is dealt to a few large shards. A phrase found `support` times in all is found, in at least one shard, at least that shard's
share of `support` times; so each shard is mined completely at its lowered support, and the union of what is frequent in some shard holds every
frequent phrase. All of them are then counted in the whole corpus, exactly and as text.

Shards are a few slices of the corpus, every fourth task's share by default, and not single tasks: with an absolute support, that of a task's share would sink
to 1 and prune nothing. A shard is mined by a distributed sum over 48-bit hashes of its phrases, which are counted within each run of texts first; phrases that share a hash can only raise
a count, so no frequent one is lost. The union reaches the counting scan as a filter of at most FILTER_BITS bits. A larger union is
cut by hash range, one filter and one scan each. What a filter lets through by chance is counted as exactly as the rest
and falls to the support.

Phrases have 1 to `longest` words; those of two and more are candidates. A candidate's lowest-scoring cut counts, ties to the shortest first part.
Counts of its parts are looked up by joins in which a part of very many candidates is dealt to pieces. Arithmetic is on decimals.

Defined results: null text is empty; null language is `und`; repeated rows count each; no rows, or none frequent, give no phrases. A text longer than a run is
cut at the ends of pieces; a piece is always whole. Other columns are not read. Counts may go up to 10^14.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.encoded import encode
from ledgerloom.llm.shared import texts_of
from ledgerloom.plans.skew import lookup_join
from ledgerloom.plans.workspace import run_folder

BREAKS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
SHARDS, SHARDS_MOST = 4, 16
RUN_BYTES, BATCH_ROWS = 6 << 20, 1 << 17  # text that is counted at once, rows handed on at once
FILTER_BITS, BITS_EACH = 1 << 29, 16  # 64 MB, for 33 million phrases
BUCKETS = 64  # pieces of a language in its top-k
HASH_BITS = 48
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _cut(text: bytes) -> list[bytes]:
    """A long text in parts that end where a piece ends."""
    parts, begin = [], 0
    while len(text) - begin > RUN_BYTES:
        ends = np.flatnonzero(np.isin(np.frombuffer(text[begin + RUN_BYTES:], dtype=np.uint8), list(BREAKS)))
        if not len(ends):
            break
        parts.append(text[begin:begin + RUN_BYTES + ends[0]])
        begin += RUN_BYTES + int(ends[0])
    return [*parts, text[begin:]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a task by language, gathered over batches up to about RUN_BYTES of text in all."""
    held, size = {}, 0
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text")), strict=True):
            for part in _cut(text):
                held.setdefault(lang, []).append(part)
                size += len(part)
                if size >= RUN_BYTES:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


class Phrases:
    """The distinct phrases of a run of texts with their counts and hashes, by number of words."""

    def __init__(self, lang: str, texts: list[bytes], longest: int) -> None:
        words = encode(texts, BLANKS, BREAKS, lower=True)
        self.n_words = len(words.ids)
        seed = xxhash.xxh64_intdigest(lang.encode())
        one = np.array([xxhash.xxh64_intdigest(w, seed) for w in words.vocabulary.to_pylist()], dtype=np.uint64)
        self.vocabulary, self.levels = words.vocabulary, []
        for width, (at, number, size) in enumerate(words.runs(longest), 1):
            counts = np.bincount(number, minlength=size)
            first = np.empty(size, dtype=np.int64)
            first[number] = at  # any place of the phrase tells its words
            members = [words.ids[first + j] for j in range(width)]
            h = np.full(size, width, dtype=np.uint64)
            for m in members:
                h = _mixed(h + one[m])
            self.levels.append((members, counts, (h >> np.uint64(64 - HASH_BITS)).astype(np.int64)))

    def texts(self, width: int, keep: np.ndarray) -> pa.Array:
        """The phrases of `width` words at the given places, space-joined."""
        parts = [self.vocabulary.take(pa.array(m[keep])) for m in self.levels[width - 1][0]]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if width > 1 else parts[0]
        return joined.cast(pa.large_utf8()).cast(pa.utf8())


def _hashes(longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _runs(batches):
            found = Phrases(lang, texts, longest)
            hashes = np.concatenate([h for _, _, h in found.levels])
            counts = np.concatenate([c for _, c, _ in found.levels])
            for at in range(0, len(hashes), BATCH_ROWS):
                part = slice(at, at + BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[part]), pa.array(counts[part].astype(np.int64))], ["hash", "n"])

    return count


def shares(docs: DataFrame) -> dict[int, float]:
    """Each shard's share of the text, at most one row a shard. Whatever the shares are, as long as they add up to 1 no phrase is lost."""
    rows = docs.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("size")).collect()
    total = sum(r["size"] for r in rows) or 1
    return {r["shard"]: r["size"] / total for r in rows}


def locally_frequent(docs: DataFrame, support: int, longest: int, shards: int) -> DataFrame:
    """Hashes of the phrases frequent in at least one shard, each once. Rows: lang, text."""
    shard = F.pmod(F.spark_partition_id(), F.lit(shards))
    share = shares(docs.withColumn("shard", shard))
    found = docs.mapInArrow(_hashes(longest), "hash long, n long")
    placed = found.select((F.col("hash") * SHARDS_MOST + shard).alias("place"), "n")
    # Counted within runs of text already: dealt by place without another sum on the map side.
    counts = placed.repartition("place").groupBy("place").agg(F.sum("n").alias("n"))
    least = F.lit(0.0)
    for number, part in share.items():
        # A hair lower, so that rounding loses nothing.
        least = F.when(F.pmod("place", F.lit(SHARDS_MOST)) == number, F.lit(support * part * (1 - 1e-9))).otherwise(least)
    return counts.where(F.col("n") >= least).select(F.shiftright("place", 4).alias("hash")).distinct()


def _filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter with the given hashes, gathered as 64-bit words with at least one bit set."""
    places = F.explode(F.array(*[_place(F.col("hash"), k, bits) for k in range(2)]))
    words = (hashes.select(places.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")))
    out = np.zeros(bits // 64, dtype=np.uint64)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["set"].to_numpy().view(np.uint64)
    return out


def _place(value: Column, k: int, bits: int) -> Column:
    return F.pmod(F.shiftright(value, 9 * k), F.lit(bits))


def _part(value: Column | np.ndarray, parts: int):
    """The part of a hash, from its highest bits."""
    return F.pmod(F.shiftright(value, 38), F.lit(parts)) if isinstance(value, Column) else (value >> 38) % parts


def _passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits, found = len(filter_) * 64, np.ones(len(hashes), dtype=bool)
    for k in range(2):
        at = (hashes >> (9 * k)) % bits
        found &= (filter_[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
    return found


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    owner = pa.repeat(pa.scalar(lang, pa.utf8()), len(phrases))
    return pa.RecordBatch.from_arrays([owner, phrases, pa.array(counts.astype(np.int64))], ["lang", "phrase", "n"])


def _counts(longest: int, filter_, part: int, parts: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = filter_.value
        for lang, texts in _runs(batches):
            found = Phrases(lang, texts, longest)
            if part == 0:
                yield _rows(lang, pa.nulls(1, pa.utf8()), np.array([found.n_words]))
            for width, (_, n, h) in enumerate(found.levels, 1):
                keep = np.flatnonzero(_passes(members, h) & (_part(h, parts) == part))
                for at in range(0, len(keep), BATCH_ROWS):
                    some = keep[at:at + BATCH_ROWS]
                    yield _rows(lang, found.texts(width, some), n[some])

    return count


def frequent_phrases(docs: DataFrame, support: int = 10, longest: int = 3, shards: int = SHARDS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, a: every phrase of 1 to `longest` words with at least `support` occurrences, and a row per language with a null phrase
    and the number of its words. Written below the shared folder."""
    if not 1 <= shards <= SHARDS_MOST:
        raise ValueError(f"1 to {SHARDS_MOST} shards")
    spark = docs.sparkSession
    folder = run_folder(spark, "collocations")
    dealt = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    locally_frequent(dealt, support, longest, shards).write.parquet(f"{folder}/union")
    union = spark.read.parquet(f"{folder}/union")
    size = union.count()
    parts = max(1, -(-size * BITS_EACH // filter_bits))
    bits = min(filter_bits, 1 << max(10, (size * BITS_EACH - 1).bit_length() if size else 0))
    for part in range(parts):
        members = spark.sparkContext.broadcast(_filter(union.where(_part(F.col("hash"), parts) == part), bits))
        found = dealt.mapInArrow(_counts(longest, members, part, parts), "lang string, phrase string, n long")
        (found.groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where((F.col("a") >= support) | F.col("phrase").isNull())
         .write.parquet(f"{folder}/counted/part={part}"))
        members.unpersist()
    return spark.read.parquet(f"{folder}/counted").select("lang", "phrase", "a")


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(14,0)")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates with the counts of the parts of their lowest-scoring cut. Rows: lang, phrase, a."""
    split = phrases.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("first"),
        F.array_join(F.slice("words", k + 1, F.size("words") - k), " ").alias("rest"))))
    rows = split.select("lang", "phrase", "a", cuts.alias("cut")).select("lang", "phrase", "a", "cut.*")
    for part, count in (("first", "l"), ("rest", "r")):
        lookup = phrases.select("lang", F.col("phrase").alias(part), F.col("a").alias(count))
        rows = lookup_join(rows, lookup, ["lang", part], ["phrase", "k"], how="inner")
    whole = F.lit(1000000).cast("decimal(7,0)") * _exact("a") * _exact("a")
    rows = rows.withColumn("whole", whole).withColumn("parts", _exact("l") * _exact("r")).withColumn("score", F.expr("whole div parts"))
    return (rows.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
            .select("lang", "phrase", "best.a", "best.l", "best.r", "best.score"))


def not_inside(candidates: DataFrame, phrases: DataFrame, share: int = 50) -> DataFrame:
    """Candidates without those whose words lie inside a longer one with at least `share` percent of their occurrences."""
    split = phrases.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 2)
    size = F.size("words")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(
        F.sequence(F.lit(1), size - n + 1), lambda at: F.array_join(F.slice("words", at, n), " "))))
    covered = (split.select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase")
               .agg(F.max("a").alias("longer")))
    return (candidates.join(covered, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer"))


def collocations(docs: DataFrame, support: int = 10, longest: int = 3, best: int = 2000, shards: int = SHARDS,
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """The `best` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    counted = frequent_phrases(docs, support, longest, shards, filter_bits)
    phrases, totals = counted.where(F.col("phrase").isNotNull()), counted.where(F.col("phrase").isNull())
    # Written once: it is ranked twice.
    at = run_folder(spark, "collocations-scored")
    not_inside(scored(phrases), phrases).withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))).write.parquet(at)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    rows = spark.read.parquet(at)
    # The best of each bucket first: a language with most of the phrases is not sorted in one task.
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("place") <= best)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    # Now at most `best` rows a language.
    return (rows.join(totals.select("lang", F.col("a").alias("n")), "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
