"""Users, holders, dimensions and codes."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.skew import lookup_join
from ledgerloom.sources.dimensions import CATEGORIES, FREQUENCIES, SUBCATEGORIES, TYPES, name_of


def user_accounts(users: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each user with the number of accounts held; counted before the join, so a
    holder of very many accounts is one row there."""
    held = accounts.groupBy(F.col("holder").alias("username")).agg(
        F.count(F.lit(1)).alias("account_count"))
    return users.join(held, "username", "left").withColumn(
        "account_count", F.coalesce("account_count", F.lit(0)))


def held_accounts(users: DataFrame, accounts: DataFrame) -> DataFrame:
    """The accounts of each user."""
    known = users.select(F.col("username").alias("holder"))
    return lookup_join(accounts, known, ["holder"], ["account_id"], "inner").select(
        "holder", "account_id", "name", "number", "currency", "balance")


def holder_transactions(
    users: DataFrame, accounts: DataFrame, rows: DataFrame, counts: DataFrame | None = None,
) -> DataFrame:
    """Ledger rows with the user who holds their account. `counts` may give the
    rows per account."""
    holders = held_accounts(users, accounts).select("account_id", F.col("holder").alias("username"))
    return lookup_join(rows, holders, ["account_id"], ["tid"], "inner", counts=counts)


def dimension_lists(dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """The names of each dimension, by kind and name."""
    lists = [d.select(F.lit(kind).alias("kind"), "name") for kind, d in dimensions.items()]
    return reduce(DataFrame.unionByName, lists).orderBy("kind", "name")


def resolve_ids(entries: DataFrame) -> DataFrame:
    """Entry rows with names in place of the codes of a form."""
    codes = {"type_id": ("type", TYPES), "category_id": ("category", CATEGORIES),
             "subcategory_id": ("subcategory", SUBCATEGORIES), "frequency_id": ("frequency", FREQUENCIES)}
    return entries.select(*[
        name_of(F.col(c), codes[c][1]).alias(codes[c][0]) if c in codes else F.col(c)
        for c in entries.columns])
