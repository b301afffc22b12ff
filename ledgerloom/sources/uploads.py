"""Uploaded files as DataFrames: JSON records, home-banking CSV, bank statements."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.skew import lookup_join
from ledgerloom.plans.workspace import checkpointed
from ledgerloom.sources.json_arrays import read_array

# Accepted extensions and the columns of the three formats.
EXTENSIONS = ["json", "csv", "dbcsv"]
JSON_SCHEMA = (
    "tid long, date string, amount decimal(18,2), type string, description string, "
    "category string, subcategory string, tag string, status boolean, payee string, "
    "closing_balance double"
)
HOMEBANK_SCHEMA = (
    "date string, paymode string, info string, payee string, wording string, "
    "amount string, category string, tags string"
)
STATEMENT_COLUMNS = {
    "Value date": "value_date",
    "Transaction Type": "transaction_type",
    "Debit": "debit",
    "Credit": "credit",
    "Payment Details": "payment_details",
    "Beneficiary / Originator": "beneficiary",
}
STATEMENT_PREAMBLE = 4
STATEMENT_CHARSET = "ISO-8859-1"


def extension(file_name: Column) -> Column:
    """What follows the last dot, in lower case; empty if there is no dot."""
    return F.lower(F.regexp_extract(file_name, r"\.([^.]*)$", 1))


def accepted_file(file_name: Column) -> Column:
    return extension(file_name).isin(EXTENSIONS)


def extension_glob(ext: str) -> str:
    """Matches the extension in any case."""
    return "*." + "".join(f"[{c}{c.upper()}]" for c in ext)


def account_in_path(file: str = "_metadata.file_path") -> Column:
    """The account of a file that lies below a folder `account_id=...`."""
    return F.regexp_extract(file, r"/account_id=(\d+)/", 1).try_cast("long")


def _positioned(df: DataFrame) -> DataFrame:
    """With the file and an increasing position inside the upload."""
    return df.withColumns({"file": F.col("_metadata.file_path"), "pos": F.monotonically_increasing_id()})


def read_json_records(
    spark: SparkSession, path: str, lines: bool = False, pattern: str | None = None,
    schema: str = JSON_SCHEMA,
) -> DataFrame:
    """JSON records: an array per file, cut into records by many tasks (`json_arrays`), or with `lines=True` one record per line.
    A file that is not JSON stops the read: nothing of it would be a ledger row."""
    pattern = pattern or extension_glob("json")
    if not lines:
        return read_array(spark, path, schema, pattern)
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", pattern)
    return _positioned(reader.option("recursiveFileLookup", "true").json(path))


def read_homebank(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = (spark.read.schema(HOMEBANK_SCHEMA).option("sep", ";").option("header", "true")
              .option("recursiveFileLookup", "true").option("pathGlobFilter", pattern or extension_glob("csv")))
    return _positioned(reader.csv(path))


def statement_text(scan: DataFrame) -> DataFrame:
    """Lines of text files with their file and the start of their block."""
    return scan.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.decode(F.col("value").cast("binary"), STATEMENT_CHARSET).alias("line"),
    )


def parse_statement(text: DataFrame, others: Mapping[str, str] | None = None) -> DataFrame:
    """Statement lines as rows: four lines of preamble, a header, then fields.

    Columns are taken by header name, `others` adding to the usual ones; a column
    or field that is absent is null.
    """
    # Header and rows are told apart by these positions, which must be the same for both: the lines are written once.
    lines = checkpointed(text.withColumn("pos", F.monotonically_increasing_id()))
    # Positions run on without gaps inside a block, so the header is the line at
    # the first position of the first block plus the preamble.
    files = lines.groupBy("file").agg(
        F.min(F.when(F.col("block") == 0, F.col("pos"))).alias("first"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    headers = (
        lines.where(F.col("block") == 0)
        .join(files.select("file", (F.col("first") + STATEMENT_PREAMBLE).alias("pos")), ["file", "pos"])
        .select("file", F.col("pos").alias("header_pos"),
                F.transform(F.split("line", ";"), F.trim).alias("names"))
    )
    body = lookup_join(lines, headers, ["file"], ["pos"], "inner", counts=files)
    body = body.where((F.col("block") > 0) | (F.col("pos") > F.col("header_pos")))
    fields = F.split("line", ";", -1)
    columns = {**STATEMENT_COLUMNS, **(others or {})}

    def named(name: str) -> Column:
        at = F.array_position("names", F.lit(name)).cast("int")
        return F.when(at > 0, F.nullif(F.try_element_at(fields, F.greatest(at, F.lit(1))), F.lit("")))

    return body.where(F.length(F.trim("line")) > 0).select(
        "file", "pos", *[named(name).alias(alias) for name, alias in columns.items()])


def read_statement(
    spark: SparkSession, path: str, pattern: str | None = None, others: Mapping[str, str] | None = None,
) -> DataFrame:
    """Bank statements, read line by line, so a large one is split over tasks."""
    scan = (spark.read.option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern or extension_glob("dbcsv")).text(path))
    return parse_statement(statement_text(scan), others)
