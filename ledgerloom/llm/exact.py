"""Exact deduplication in two passes over a Bloom filter, with DataFrame functions only.

Pass one hashes every text into two bits of a filter and keeps the bits that were set
more than once, as bitmaps of 4 KB. Pass two tests each row: a row with a bit that nobody
else set has no copy and passes straight through; only the rest is shuffled, and grouped by the whole
digest. The filter has 16 bits a row at any number of rows. Up to MAX_BITS its bitmaps, at most MAX_BITS / 8
bytes (32 MB), are broadcast whole. A larger one is cut by ranges of the digest into slices of MAX_BITS: the rows are written once, ordered by
digest inside their tasks (which moves nothing), and each slice reads its range of every file, broadcasts its own bitmaps and writes its
rows. So the bitmaps in memory stay as they are, and the share of rows that shuffle does not grow with the rows.

Texts are equal when they are identical without the characters space, \\t, \\n, \\v, \\f and \\r.
Defined results: null text is empty text; of equal texts the one with most code points stays,
then the smallest id, null ids last; several rows of the winner's id and length are all marked kept by
`decide`, and `deduplicate` lets one of them through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.skew import lookup_join
from ledgerloom.plans.workspace import checkpointed, run_folder

BITS_PER_ROW = 16
MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
BLANKS = "[\\x20\\x09-\\x0D]+"


def digest(text: str | Column) -> Column:
    """SHA-256 of the text without blanks, in hexadecimal."""
    column = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.regexp_replace(F.coalesce(column, F.lit("")), BLANKS, ""), 256)


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_ROW * max(rows, 1) - 1).bit_length()))


def slices(rows: int) -> list[tuple[str, str]]:
    """Ranges of the digest (from, up to but without) whose share of the rows has a filter of at most MAX_BITS."""
    n = max(1, -(-BITS_PER_ROW * rows // MAX_BITS))
    cuts = [f"{-(-k * (1 << 32) // n):08x}" for k in range(n)]
    return list(zip(cuts, [*cuts[1:], "g"], strict=True))


def _by_slice(rows: DataFrame, key: str, ranges: list[tuple[str, str]], of: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """`of` applied to the rows of each range, one after the other, so that the bitmaps of one are held at a time."""
    spark, folder = rows.sparkSession, run_folder(rows.sparkSession, "slices")
    rows.sortWithinPartitions(key).write.parquet(f"{folder}/rows")
    held = spark.read.parquet(f"{folder}/rows")
    for k, (low, high) in enumerate(ranges):
        of(held.where((F.col(key) >= low) & (F.col(key) < high)), low, high).write.parquet(f"{folder}/done/slice={k}")
    return spark.read.parquet(*[f"{folder}/done/slice={k}" for k in range(len(ranges))])


def _places(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(bits)) + 1 for seed in (1, 2)]


def repeated_bits(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Bitmaps of the places that more than one row has set: bucket, bitmap."""
    places = keys.select(F.explode(F.array_distinct(F.array(*_places(key, bits)))).alias("place"))
    often = places.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (often.groupBy(F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")))


def with_suspicion(rows: DataFrame, key: str, bitmaps: DataFrame, bits: int, out: str) -> DataFrame:
    """Adds whether the key may be repeated; false is certain."""
    flags, own = [], rows.columns
    for i, place in enumerate(_places(key, bits)):
        bucket, bitmap = f"__bucket{i}", f"__bitmap{i}"
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
        rows = rows.join(side, F.bitmap_bucket_number(place) == F.col(bucket), "left")
        bit = F.bitmap_bit_position(place)
        byte = F.conv(F.hex(F.substring(F.col(bitmap), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        flags.append(F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)))
    return rows.select(*own, (flags[0] & flags[1]).alias(out))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, digest and code points of each row; the text is read and hashed once."""
    return checkpointed(docs.select(
        F.col(doc_id).alias("doc_id"), digest(text).alias("text_sha256"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars")))


def _winners(suspects: DataFrame) -> DataFrame:
    rank = F.struct((-F.col("chars")).alias("shorter"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"))
    return (suspects.groupBy("text_sha256").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
            .select("text_sha256", F.col("best.doc_id").alias("keep_id"), (-F.col("best.shorter")).alias("keep_chars"), "group_size"))


def marked(marks: DataFrame) -> DataFrame:
    """Fingerprints with `suspect`: whether a row may have a copy."""
    def of(part: DataFrame, low: str, high: str) -> DataFrame:
        return with_suspicion(part, "text_sha256", checkpointed(repeated_bits(part, "text_sha256", bits)), bits, "suspect")

    rows = marks.count()
    bits, ranges = filter_bits(rows), slices(rows)
    return of(marks, *ranges[0]) if len(ranges) == 1 else _by_slice(marks, "text_sha256", ranges, of)


def decide(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    marks = marked(fingerprints(docs, doc_id, text))
    alone = marks.where(~F.col("suspect")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    suspects = marks.where("suspect")
    winners = _winners(suspects)
    # A large group is dealt to pieces; only its one winner is repeated.
    counts = winners.select("text_sha256", F.col("group_size").alias("n_rows"))
    grouped = lookup_join(suspects, winners, ["text_sha256"], ["doc_id"], "inner", counts=counts).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with all its columns. Rows without a possible copy are not shuffled."""
    marks = fingerprints(docs, doc_id, text)
    count = marks.count()
    bits, ranges = filter_bits(count), slices(count)
    if len(ranges) > 1:
        ordered = run_folder(docs.sparkSession, "marks")
        marks.sortWithinPartitions("text_sha256").write.parquet(ordered)
        marks = docs.sparkSession.read.parquet(ordered)

    def of(rows: DataFrame, low: str, high: str) -> DataFrame:
        near = marks if len(ranges) == 1 else marks.where((F.col("text_sha256") >= low) & (F.col("text_sha256") < high))
        bitmaps = checkpointed(repeated_bits(near, "text_sha256", bits))
        winners = _winners(with_suspicion(near, "text_sha256", bitmaps, bits, "suspect").where("suspect"))
        rows = with_suspicion(rows, "__digest", bitmaps, bits, "__suspect")
        alone = rows.where(~F.col("__suspect")).select(*docs.columns)
        # Only rows that are equal in digest, id and length meet here, so a large group spreads over the tasks.
        best = rows.where("__suspect").join(
            winners, (F.col("__digest") == winners["text_sha256"]) & F.col(doc_id).eqNullSafe(winners["keep_id"])
            & (F.length(F.coalesce(F.col(text), F.lit(""))) == winners["keep_chars"]), "left_semi")
        return alone.unionByName(best.dropDuplicates(["__digest"]).select(*docs.columns))

    rows = docs.withColumn("__digest", digest(text))
    return of(rows, *ranges[0]) if len(ranges) == 1 else _by_slice(rows, "__digest", ranges, of)
