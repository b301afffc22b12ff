"""Text rules of the ledger columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.schema import MISSING


def bounded(col: Column, longest: int, default: str = MISSING) -> Column:
    """The text if it has 1 to `longest` characters, else the default."""
    return F.when(F.length(col).between(1, longest), col).otherwise(F.lit(default))


def or_missing(col: Column) -> Column:
    return F.coalesce(col, F.lit(MISSING))


def clean_search_pattern(text: str) -> str:
    """A user's search text as a regex in which only `|` keeps its meaning."""
    # The characters that lose their special meaning.
    escaped = "[^$.?*+(){}"
    text = text.replace("\\", "")
    text = "".join("\\" + c if c in escaped else c for c in text)
    return re.sub(r"\|+", "|", text).removesuffix("|")
