"""Cleaning of uploaded rows before they meet the ledger."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import parse_money
from ledgerloom.functions.text import or_missing
from ledgerloom.operators.dedup import first_of_each
from ledgerloom.operators.taxonomy import reformat_taxonomy
from ledgerloom.schema import MISSING, MONEY
from ledgerloom.sources.dimensions import TYPES, name_of

# How statement wordings become types, first match wins.
STATEMENT_TYPES = [
    ("Cash", "Cash"),
    ("Credit", "Electronic payment"),
    ("Debit Card", "Debit card"),
    ("Standing Order", "Electronic payment"),
    ("Direct Debit", "Electronic payment"),
]


def _filled(text: Column) -> Column:
    """The text without outer blanks; null if that leaves nothing."""
    return F.nullif(F.trim(text), F.lit(""))


def homebank_date(text: Column) -> Column:
    """Day first, with or without leading zeros."""
    return F.try_to_date(_filled(text), "d/M/yyyy")


def statement_date(text: Column) -> Column:
    """Month first, with or without leading zeros, or in ISO form."""
    return F.coalesce(F.try_to_date(_filled(text), "M/d/yyyy"), F.substring(_filled(text), 1, 10).try_cast("date"))


def json_date(text: Column) -> Column:
    """In ISO form, with or without a time, or milliseconds since 1970. Eight digits are year, month and day, or unreadable."""
    days = F.when(_filled(text).rlike(r"^\d{8}$"), F.try_to_date(_filled(text), "yyyyMMdd"))
    millis = F.when(_filled(text).rlike(r"^-?\d{5,}$") & ~_filled(text).rlike(r"^\d{8}$"), _filled(text).try_cast("long"))
    return F.coalesce(days, F.to_date(F.timestamp_millis(millis)), F.substring(_filled(text), 1, 10).try_cast("date"))


def unreadable_dates(raw: DataFrame, name: str, read: Callable[[Column], Column]) -> DataFrame:
    """The uploaded rows whose date is given but cannot be read. Later steps would give them the load date."""
    return raw.where(_filled(F.col(name)).isNotNull() & read(F.col(name)).isNull())


def clean_homebank(raw: DataFrame) -> DataFrame:
    """Ledger names, completed, and no gaps in the text columns."""
    keep = [c for c in ("file", "pos", "account_id") if c in raw.columns]
    return raw.select(
        *keep,
        homebank_date(F.col("date")).alias("date"),
        parse_money(F.col("amount")).alias("amount"),
        F.col("paymode").alias("type"),
        or_missing(F.col("wording")).alias("description"),
        or_missing(F.col("category")).alias("category"),
        or_missing(F.col("tags")).alias("tag"),
        F.lit(True).alias("status"),
        or_missing(F.col("payee")).alias("payee"),
    )


def split_category(rows: DataFrame) -> DataFrame:
    """`Category:Subcategory` in two columns; parts after the second are dropped."""
    parts = F.split("category", ":")
    second = F.nullif(F.try_element_at(parts, F.lit(2)), F.lit(""))
    return rows.withColumns({
        "category": F.try_element_at(parts, F.lit(1)),
        "subcategory": F.when(F.col("category").isNotNull(), F.coalesce(second, F.lit(MISSING))),
    })


def map_paymode(rows: DataFrame, types: Mapping[int, str] = TYPES) -> DataFrame:
    """Type codes as names; a code without a name becomes null."""
    return rows.withColumn("type", name_of(F.col("type").try_cast("int"), types))


def homebank_rows(raw: DataFrame) -> DataFrame:
    """A home-banking export as ledger rows, each purchase once."""
    rows = split_category(clean_homebank(raw))
    return first_of_each(map_paymode(reformat_taxonomy(rows)))


def json_rows(raw: DataFrame) -> DataFrame:
    """A JSON upload as ledger rows: ids and balances of the file are not kept."""
    dropped = [c for c in ("tid", "closing_balance") if c in raw.columns]
    return raw.withColumns({
        "date": json_date(F.col("date")),
        "amount": F.col("amount").cast(MONEY),
    }).drop(*dropped)


def statement_amount(raw: DataFrame) -> DataFrame:
    """Debit plus credit. A blank side is 0, an unreadable one makes the amount
    null, and rows with an amount of exactly 0 are dropped."""

    def side(name: str) -> Column:
        text = F.coalesce(F.col(name), F.lit("0"))
        return parse_money(F.replace(F.replace(text, F.lit('",'), F.lit("")), F.lit(","), F.lit("")))

    rows = raw.withColumn("amount", (side("debit") + side("credit")).cast(MONEY))
    return rows.where(F.col("amount").isNull() | (F.col("amount") != 0))


def statement_type(col: Column) -> Column:
    text = F.replace(col, F.lit('""'), F.lit(""))
    kind = None
    for wording, name in STATEMENT_TYPES:
        found = F.contains(text, F.lit(wording))
        kind = F.when(found, name) if kind is None else kind.when(found, name)
    return kind.otherwise(text)


def statement_rows(raw: DataFrame) -> DataFrame:
    """A raw statement as staging rows."""
    keep = [c for c in ("file", "pos") if c in raw.columns]
    return statement_amount(raw).select(
        *keep,
        "account_id",
        statement_date(F.col("value_date")).alias("date"),
        "amount",
        F.col("payment_details").alias("description"),
        "beneficiary",
        statement_type(F.col("transaction_type")).alias("type"),
    )
