"""Money columns: exact decimals inside, doubles only at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schema import MONEY


def parse_money(col: Column) -> Column:
    """Text (or a number) as money; null where it is not a number."""
    return F.trim(col.cast("string")).try_cast(MONEY)


def as_double(col: Column) -> Column:
    return col.cast("double")


def edge(df: DataFrame) -> DataFrame:
    """Every decimal column as a double, for output."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("double").alias(f.name)
        if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def percent_half_up(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded half up to 2 places, for part >= 0 and whole > 0.

    Integer arithmetic on cents, so no binary rounding takes part.
    """
    a = (part * 100).cast("decimal(28,0)")
    b = (whole * 100).cast("decimal(28,0)")
    numerator = (a * F.lit(20000).cast("decimal(5,0)") + b).cast("decimal(38,0)")
    denominator = (b * F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)")
    hundredths = F.call_function("div", numerator, denominator)
    return hundredths.cast("double") / F.lit(100.0)
