"""Incremental ingest: upload files that arrive one by one become rows, each once.

Home-banking exports and JSON records go to the ledger, bank statements to the
staging rows that wait for review.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.cleaning import homebank_rows, json_rows, statement_rows
from ledgerloom.operators.dedup import first_of_each, new_rows
from ledgerloom.plans.workspace import checkpointed
from ledgerloom.schema import LEDGER, STAGING
from ledgerloom.sources import json_arrays
from ledgerloom.sources.stores import append_rows, open_store
from ledgerloom.sources.uploads import (
    HOMEBANK_SCHEMA, JSON_SCHEMA, account_in_path, extension_glob, parse_statement, statement_text,
)

SCHEMAS = {"csv": LEDGER, "json": LEDGER, "dbcsv": STAGING}

Clean = Callable[[DataFrame], DataFrame]


def stored_rows(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """What has been ingested so far, with the year and the batch each row came in."""
    return open_store(spark, path, SCHEMAS[kind])  # fails where nothing was ingested yet


def _stream(
    spark: SparkSession, kind: str, uploads: str, files_per_batch: int, pattern: str, lines: bool,
) -> DataFrame:
    reader = (spark.readStream.option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", pattern))
    if kind == "csv":
        return reader.schema(HOMEBANK_SCHEMA).option("sep", ";").option("header", "true").csv(uploads)
    if kind == "json" and lines:
        return reader.schema(JSON_SCHEMA).option("mode", "FAILFAST").json(uploads)
    if kind == "json":
        return reader.option("lineSep", "}").text(uploads)
    return reader.text(uploads)


def _cleaner(kind: str, account: Column, lines: bool = False) -> Clean:
    """From the rows of one batch to rows as they are stored."""
    def placed(raw: DataFrame) -> DataFrame:
        return raw.withColumns({"account_id": account, "pos": F.monotonically_increasing_id()})

    if kind == "csv":
        return lambda batch: homebank_rows(placed(batch))
    if kind == "json" and lines:
        return lambda batch: first_of_each(json_rows(placed(batch)))
    if kind == "json":
        return lambda batch: first_of_each(json_rows(json_arrays.records(batch, JSON_SCHEMA).withColumn("account_id", account)))
    return lambda batch: statement_rows(parse_statement(batch).withColumn("account_id", account))


def earlier_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored rows that can equal one of the rows: of the same years, found by one aggregate. The year is a
    folder, so no others are opened."""
    span = rows.agg(F.min(F.year("date")).alias("first"), F.max(F.year("date")).alias("last"),
                    F.bool_or(F.col("date").isNull()).alias("undated")).head()
    same = F.col("year").between(span["first"], span["last"]) if span["first"] is not None else F.lit(False)
    return stored.where(same | F.col("year").isNull() if span["undated"] else same)


def _store(path: str, kind: str, clean: Clean, stream: str) -> Callable[[DataFrame, int], None]:
    def store(batch: DataFrame, batch_id: int) -> None:
        # Parsed and cleaned once, whatever is asked of the rows afterwards.
        rows, name = checkpointed(clean(batch)), f"{stream}-{batch_id}"
        if kind != "dbcsv":
            stored = open_store(batch.sparkSession, path, SCHEMAS[kind], missing_ok=True, without_batch=name)
            rows = new_rows(rows, earlier_rows(rows, stored))
        # A batch that runs again after a failure replaces itself.
        append_rows(rows, path, name, SCHEMAS[kind])

    return store


def ingest_new_files(
    spark: SparkSession, uploads: str, store: str, checkpoint: str, kind: str = "csv",
    files_per_batch: int = 1000, account: Column | None = None, pattern: str | None = None, lines: bool = False,
) -> None:
    """Ingest the files of one kind that have arrived since the last call.

    `kind` is an accepted extension and picks the parser. `account` tells a row's
    account; by default it is in the path of the file (`account_id=...`). Each
    batch is cleaned like any upload and, for the ledger, checked against the rows
    of the batches before it, so a file given twice adds nothing. Every row gets an id; rows
    without an account are left out. JSON files hold an array each, or one record per line (`lines`); both are split over tasks.
    """
    if kind not in SCHEMAS:
        raise ValueError(f"files are one of {', '.join(SCHEMAS)}")
    scan = _stream(spark, kind, uploads, files_per_batch, pattern or extension_glob(kind), lines)
    if kind == "json" and not lines:
        files = json_arrays.array_text(scan)
    else:
        files = statement_text(scan) if kind == "dbcsv" else scan.withColumn("file", F.col("_metadata.file_path"))
    clean = _cleaner(kind, account_in_path("file") if account is None else account, lines)
    query = (files.writeStream.foreachBatch(_store(store, kind, clean, f"{kind}-{crc32(checkpoint.encode()):08x}"))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
