"""Each purchase once: inside an upload, and against the ledger."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.skew import lookup_join, piece_rows
from ledgerloom.plans.workspace import stored
from ledgerloom.schema import NATURAL_KEY


def first_of_each(
    rows: DataFrame, keys: Sequence[str] = tuple(NATURAL_KEY), order: str = "pos",
) -> DataFrame:
    """The first row, by position, of each key; null parts of a key are equal.

    An aggregate, not a window: copies are already reduced on the map side, so a
    key with very many copies sends one row per task.
    """
    others = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.col(order))
    return (rows.groupBy(*keys).agg(first.alias("first"))
            .select(*keys, "first.*").select(*rows.columns))


def new_rows(
    upload: DataFrame, ledger: DataFrame, keys: Sequence[str] = tuple(NATURAL_KEY),
) -> DataFrame:
    """Rows of the upload whose key is not in the ledger, nulls being equal. Take
    copies out of the upload first (`first_of_each`): then no key is hot."""
    known = ledger.select(*[F.col(k).alias(f"known_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys])
    return upload.join(known, same, "left_anti")


def _values(rows: DataFrame, column: str, *keep: str) -> DataFrame:
    """The values of one column as text, null or not."""
    return rows.select(*keep, F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")).alias("text"))


def new_rows_columnwise(
    upload: DataFrame, ledger: DataFrame, columns: Sequence[str], row_id: str = "pos",
) -> DataFrame:
    """Rows of the upload with at least one value that its column of the account's
    ledger does not have. A row is left out when each of its values occurs
    somewhere in its column, even if no single ledger row has them all.

    Columns are added up and joined one after the other, so no task holds the values of several. Both sides become distinct values by account in one
    aggregate, on the map side, so a value that most rows have is one row. Only the upload's unknown values go back to its rows.
    """
    cell, limit = ["account_id", "text"], piece_rows(upload.sparkSession)
    ledger = ledger.where(F.col("account_id").isNotNull())  # no account is not the same account: such rows stay

    def cells(c: str) -> DataFrame:
        """The values of a column that the ledger does not have, and those of very many rows of the upload."""
        both = _values(upload, c, "account_id").withColumn("n", F.lit(1)).unionByName(_values(ledger, c, "account_id").withColumn("n", F.lit(0)))
        counts = both.groupBy(*cell).agg(F.sum("n").alias("n_rows"), (F.min("n") == 1).alias("unknown"))
        return counts.where(F.col("unknown") | (F.col("n_rows") > limit))

    def rows_with(c: str) -> DataFrame:
        """The ids of the rows with an unknown value in a column."""
        own = stored(cells(c), "cells")
        found = lookup_join(_values(upload, c, "account_id", row_id), own.where("unknown").select(*cell), cell, [row_id], "left_semi",
                            counts=own, nulls_match=True)
        return stored(found.select(row_id), "picked")

    picked = reduce(DataFrame.unionByName, [rows_with(c) for c in columns])
    return upload.join(picked.distinct(), row_id, "left_semi")
