"""Checks that report instead of repairing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import parse_money
from ledgerloom.schema import NATURAL_KEY

# Lengths and patterns of account and user fields.
NAME_LENGTH, SHORT_LENGTH = 128, 64
EMAIL_PATTERN = r"^\S+@\S+\.\S+$"
USERNAME_PATTERN = r"^\S+$"


def _reasons(checks: dict[str, Column]) -> Column:
    """The names of the failed checks, joined by commas; empty if none failed."""
    return F.concat_ws(",", *[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])


def validate_accounts(raw: DataFrame) -> DataFrame:
    """Rows (account_id, name, number, currency, balance), numbers as text."""
    return raw.withColumn("reject_reason", _reasons({
        "name": F.length("name").between(1, NAME_LENGTH),
        "number": F.col("number").try_cast("int").isNotNull() & F.col("number").rlike(r"^[+-]?[0-9]+$"),
        "currency": F.length("currency").between(1, SHORT_LENGTH),
        "balance": parse_money(F.col("balance")).isNotNull(),
    }))


def validate_users(raw: DataFrame) -> DataFrame:
    def fits(name: str, pattern: str) -> Column:
        return F.length(name).between(1, SHORT_LENGTH) & F.col(name).rlike(pattern)

    return raw.withColumn("reject_reason", _reasons({
        "username": fits("username", USERNAME_PATTERN), "email": fits("email", EMAIL_PATTERN)}))


def duplicate_keys(rows: DataFrame, keys: Sequence[str] = tuple(NATURAL_KEY)) -> DataFrame:
    """Keys that occur more than once. As with a unique constraint, a key with a
    null part equals no other."""
    return (rows.dropna(subset=list(keys)).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1))
