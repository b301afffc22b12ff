"""Joins and running totals that survive one key holding a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.workspace import stored

# Rows of one key that may meet in one piece of a join. A constant: it does not grow with the data.
PIECE_SETTING = "spark.ledgerloom.pieceRows"
PIECE_ROWS = 1_000_000


def piece_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(PIECE_SETTING, str(PIECE_ROWS)))


def key_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def hot_keys(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more rows than a piece may have, and the number of pieces to cut them into.

    The list has at most one key per PIECE_ROWS rows: a few ten megabytes for 10^12 rows.
    """
    limit = piece_rows(counts.sparkSession)
    return counts.where(F.col("n_rows") > limit).select(*keys, F.ceil(F.col("n_rows") / limit).cast("int").alias("pieces"))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
    nulls_match: bool = False,
) -> DataFrame:
    """Join rows to a table with at most one row per key.

    Rows of a hot key are dealt to pieces by a hash of `spread`; only the lookup
    rows of hot keys are repeated, once per piece. Rows with a null key are a key like any other for this, whether or not
    they may find a lookup row (`nulls_match`). `counts` may pass in the rows
    per key (`n_rows`) when the caller has them or can get them for less.
    """
    keys = list(keys)
    counts = key_counts(rows, keys) if counts is None else counts.select(*keys, "n_rows")
    hot = hot_keys(counts, keys).select(*[F.col(k).alias(f"__hot_{k}") for k in keys], F.col("pieces").alias("__pieces"))
    pieces = F.coalesce(F.col("__pieces"), F.lit(1))

    def with_pieces(frame: DataFrame) -> DataFrame:
        same = _all([F.col(k).eqNullSafe(F.col(f"__hot_{k}")) for k in keys])
        return frame.join(F.broadcast(hot), same, "left")

    dealt = with_pieces(rows).select(*rows.columns, F.pmod(F.xxhash64(*spread), pieces).cast("int").alias("__piece"))
    others = [c for c in lookup.columns if c not in keys]
    repeated = with_pieces(lookup).select(
        *[F.col(k).alias(f"__key_{k}") for k in keys], *others,
        F.explode(F.sequence(F.lit(0), pieces - 1)).alias("__other"))

    def same(k: str) -> Column:
        return F.col(k).eqNullSafe(F.col(f"__key_{k}")) if nulls_match else F.col(k) == F.col(f"__key_{k}")

    found = dealt.join(repeated, _all([*map(same, keys), F.col("__piece") == F.col("__other")]), how)
    return found.select(*rows.columns, *([] if how in ("left_anti", "left_semi") else others))


def running_total(
    rows: DataFrame, openings: DataFrame, out: str = "closing_balance", newest_first: bool = False,
) -> DataFrame:
    """Opening balance plus the amounts up to each row, by account, date and tid.

    One plan for every account. The rows are ranged by account, date and tid over all tasks, so a part holds
    a run of that order, however few accounts, dates or ids there are, and is as large as any other. The sums of an account's earlier
    parts give the balance a part begins with; inside a part the rows are added up.

    Rows without an id, or without a date, come before the others (after them when the newest come first);
    rows that are equal in account, date and id are taken in any one order.
    """
    def way(c: str) -> Column:
        return F.col(c).desc_nulls_last() if newest_first else F.col(c).asc_nulls_first()

    order = [way("date"), way("tid"), F.col("__tie")]
    tied = rows.withColumn("__tie", F.xxhash64(*rows.columns))
    # The parts must be the same for their sums and for their rows: they are written once.
    parts = stored(tied.repartitionByRange(F.col("account_id"), *order).withColumn("__part", F.spark_partition_id()), "ranged")
    earlier = Window.partitionBy("account_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (parts.groupBy("account_id", "__part").agg(F.sum("amount").alias("__sum"))
              .withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
              .join(openings, "account_id", "left")
              .select(F.col("account_id").alias("__account"), F.col("__part").alias("__at"),
                      (F.coalesce("opening", F.lit(0)) + F.col("__before")).cast("decimal(28,2)").alias("__start")))
    same = F.col("account_id").eqNullSafe(F.col("__account")) & (F.col("__part") == F.col("__at"))
    inside = (Window.partitionBy("account_id", "__part").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.col("__start") + F.coalesce(F.sum("amount").over(inside), F.lit(0))
    return (parts.join(starts, same).withColumn(out, total.cast("decimal(28,2)"))
            .select(*rows.columns, out))
