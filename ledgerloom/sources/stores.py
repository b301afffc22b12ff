"""Stored ledgers and staged rows: read, append, edit, delete, promote and export.

A store is a set of folders, by the year of the rows and by lot: the rows of one batch whose ids share a slice of SLICE_ROWS. Folders are never changed. A change writes
new ones and publishes a version of the store that lists them in place of the old (`versions`); readers see one version. Each version knows the next id to
give and the ids, accounts, dates and batch of every folder, so ids, replaced batches and reads of one account or span ask no stored row.

Every row has an id that no other row of the store has, for good. The rows of a batch are numbered by account and date, so a slice holds
few accounts of a large batch, and files are ordered by account.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.edits import apply_edits, apply_staging_edits, delete_rows
from ledgerloom.plans.workspace import empty, stored
from ledgerloom.schema import LEDGER, STAGING
from ledgerloom.sources import versions
from ledgerloom.sources.versions import Folder, Version

NUMBER_BITS = 33
SLICE_ROWS = 20_000_000
PLACES = [T.StructField("batch", T.StringType()), T.StructField("commit", T.StringType()),
          T.StructField("year", T.IntegerType()), T.StructField("lot", T.StringType())]


def _read(spark: SparkSession, path: str, schema: T.StructType, folders: Iterable[Folder]) -> DataFrame:
    """All rows of the given folders with their batch, commit, year and lot."""
    whole, paths = T.StructType([*schema.fields, *PLACES]), [f"{path}/{f.path}" for f in folders]
    if not paths:
        return empty(spark, whole)
    return spark.read.schema(whole).option("basePath", path).parquet(*paths)


def rows_of(spark: SparkSession, path: str, schema: T.StructType, folders: Iterable[Folder]) -> DataFrame:
    """The rows of some folders of a store, of any version."""
    return _read(spark, path, schema, folders).select(*schema.fieldNames())


def with_files(spark: SparkSession, path: str, schema: T.StructType, folders: Iterable[Folder]) -> DataFrame:
    """The rows of some folders with the file each lies in."""
    return _read(spark, path, schema, folders).select(*schema.fieldNames(), F.col("_metadata.file_path").alias("file"))


def _version(spark: SparkSession, path: str, number: int | None = None) -> Version:
    version = versions.read(spark, path, number)
    if version is None:
        raise FileNotFoundError(f"{path} is no store" if number is None else f"{path} has no version {number}")
    return version


def open_store(
    spark: SparkSession, path: str, schema: T.StructType = LEDGER, missing_ok: bool = False, without_batch: str | None = None,
    version: int | None = None,
) -> DataFrame:
    """All rows of a store with their year and batch. Without a store there it fails, or has no rows if `missing_ok`;
    nothing is created."""
    found = versions.read(spark, path) or Version(0) if missing_ok else _version(spark, path, version)
    folders = [f for f in found.folders if without_batch is None or f.batch != without_batch]
    return _read(spark, path, schema, folders).select(*schema.fieldNames(), "year", "batch")


def _overlaps(folder: Folder, first: dt.date | None, last: dt.date | None, account: int | None) -> bool:
    if account is not None and not folder.first_account <= account <= folder.last_account:
        return False
    if first is None and last is None:
        return True
    return (folder.first_date is not None and (first is None or folder.last_date >= first.isoformat())
            and (last is None or folder.first_date <= last.isoformat()))


def read_ledger(
    spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None, account: int | None = None,
    version: int | None = None,
) -> DataFrame:
    """A stored ledger, or an earlier version of it. Bounds on the date and an account also choose the folders, so
    that no others are opened; inside a folder files are ordered by account."""
    folders = [f for f in _version(spark, path, version).folders if _overlaps(f, first, last, account)]
    rows = _read(spark, path, LEDGER, folders)
    if first is not None:
        rows = rows.where((F.col("year") >= first.year) & (F.col("date") >= F.lit(first)))
    if last is not None:
        rows = rows.where((F.col("year") <= last.year) & (F.col("date") <= F.lit(last)))
    if account is not None:
        rows = rows.where(F.col("account_id") == account)
    return ledger_rows(rows)


def read_staging(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return open_store(spark, path, STAGING, version=version).select(*STAGING.fieldNames())


def ledger_rows(stored: DataFrame) -> DataFrame:
    """The ledger columns, in order, from any wider frame."""
    return stored.select(*LEDGER.fieldNames())


def rejected(rows: DataFrame) -> DataFrame:
    """Rows that a store does not take, with the reason."""
    return rows.where(F.col("account_id").isNull()).withColumn("reason", F.lit("no account"))


def numbered(rows: DataFrame, after: int) -> DataFrame:
    """The rows with ids `after` + 1, + 2 ... Rows are numbered where they are; only the sizes of the parts meet."""
    held = stored(rows.withColumn("__n", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__n", NUMBER_BITS)
    before = F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = (held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))  # one row per part
             .select("__part", F.coalesce(before, F.lit(0)).alias("__before")))
    own = F.col("__n").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1))
    return (held.withColumn("__part", part).join(F.broadcast(sizes), "__part")
            .withColumn("tid", F.lit(after) + 1 + F.col("__before") + own).drop("__n", "__part", "__before"))


def _write(rows: DataFrame, path: str, schema: T.StructType) -> list[Folder]:
    """Write rows that have a batch as one commit; what its folders hold is read from the two key columns and the date."""
    commit = uuid.uuid4().hex
    place = F.floor(F.col("tid") / SLICE_ROWS).cast("string")
    # Of the schema's types: wider decimals (of amounts worked out) would make files that cannot be read.
    placed = rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields], "batch", F.year("date").alias("year"),
                         F.concat(F.left(F.sha2("batch", 256), F.lit(24)), F.lit("-"), place).alias("lot"))
    (placed.hint("rebalance", F.col("year"), F.col("lot")).sortWithinPartitions("year", "lot", "account_id", "date")
     .write.partitionBy("year", "lot").parquet(f"{path}/commit={commit}"))
    whole = T.StructType([*schema.fields, *[f for f in PLACES if f.name != "commit"]])
    written = rows.sparkSession.read.schema(whole).parquet(f"{path}/commit={commit}")
    bounds = {"first_id": F.min("tid"), "last_id": F.max("tid"), "first_account": F.min("account_id"), "last_account": F.max("account_id"),
              "first_date": F.min("date").cast("string"), "last_date": F.max("date").cast("string")}
    found = written.groupBy("year", "lot", "batch").agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in bounds.items()])
    return [Folder(commit=commit, **r.asDict()) for r in found.collect()]  # one row per folder


def append_rows(
    rows: DataFrame, path: str, batch: str | None = None, schema: T.StructType = LEDGER, run: tuple[str, int] | None = None,
) -> Version:
    """Append cleaned rows that have an account (see `rejected`). They get the ids after all that the store ever gave; only a batch that
    was the last to get ids, and runs again, gets the same. A batch of a name that is stored already is replaced, in all its years. `run` is noted in the
    version. A second writer at the same time is refused with StoreChanged, and what it wrote is not seen."""
    spark = rows.sparkSession
    batch = batch or f"append-{uuid.uuid4().hex}"
    version = versions.read(spark, path) or Version(0)
    old, next_id = version.of_batch(batch), version.next_id
    if old and max(f.last_id for f in old) == next_id - 1:
        others = [f.last_id for f in version.folders if f.batch != batch]
        next_id = max(min(f.first_id for f in old), max(others, default=-1) + 1)
    fields = [f.name for f in schema if f.name != "tid"]
    taken = rows.where(F.col("account_id").isNotNull()).select(*fields).repartitionByRange("account_id", "date").sortWithinPartitions("account_id", "date")
    new = _write(numbered(taken, next_id - 1).withColumn("batch", F.lit(batch)), path, schema)
    after = replace(version.without(old).with_folders(new), next_id=max([next_id, *[f.last_id + 1 for f in new]]))
    if run:
        after = replace(after, runs={**after.runs, run[0]: run[1]})
    return versions.publish(spark, path, after)


def change_rows(spark: SparkSession, path: str, ids: DataFrame, change: Callable[[DataFrame], DataFrame], schema: T.StructType = LEDGER) -> list[Folder]:
    """Rewrite the folders that hold a row with one of the ids (column tid), and no other; `change` makes their rows anew. Ids and
    batches stay. All of it is published at once; if no row is touched there is no new version. Returns the folders rewritten."""
    version = _version(spark, path)
    ids = stored(ids.select("tid").where(F.col("tid") < version.next_id).distinct(), "ids")
    # At most one value per slice of the store.
    slices = {r[0] for r in ids.select(F.floor(F.col("tid") / SLICE_ROWS)).distinct().collect()}
    near = [f for f in version.folders if int(f.lot.rpartition("-")[2]) in slices]
    if not near:
        return []
    held = _read(spark, path, schema, near).select("tid", "commit", "year", "lot").join(ids, "tid", "left_semi")
    places = {(r["commit"], r["year"], r["lot"]) for r in held.select("commit", "year", "lot").distinct().collect()}
    touched = [f for f in near if (f.commit, f.year, f.lot) in places]
    if not touched:
        return []
    rows = _read(spark, path, schema, touched).select(*schema.fieldNames(), "batch")
    new = _write(change(rows), path, schema)
    versions.publish(spark, path, version.without(touched).with_folders(new))
    return touched


def edit_ledger(spark: SparkSession, path: str, edits: DataFrame) -> list[Folder]:
    """Ledger edits by (account_id, tid) written back; an edited date moves a row to its year's folder."""
    edits = stored(edits, "edits")  # they may be read from all of the store, and are used twice
    return change_rows(spark, path, edits, lambda rows: apply_edits(rows, edits))


def edit_staging(spark: SparkSession, path: str, edits: DataFrame) -> list[Folder]:
    edits = stored(edits, "edits")
    return change_rows(spark, path, edits, lambda rows: apply_staging_edits(rows, edits), STAGING)


def remove_rows(spark: SparkSession, path: str, deletions: DataFrame, schema: T.StructType = LEDGER) -> list[Folder]:
    """Rows with the given ids deleted. Their ids are not given again."""
    deletions = stored(deletions.select("tid"), "deletions")
    return change_rows(spark, path, deletions, lambda rows: delete_rows(rows, deletions), schema)


def compact(spark: SparkSession, path: str, target: str, schema: T.StructType = LEDGER) -> None:
    """The store in few large files, in a new folder; ids stay."""
    version = _version(spark, path)
    rows = _read(spark, path, schema, version.folders).withColumn("batch", F.lit("compacted"))
    versions.publish(spark, target, Version(0, version.next_id, version.runs, tuple(_write(rows, target, schema))))


def remove_unused(spark: SparkSession, path: str, keep: int = 10) -> list[str]:
    """Delete the commits that none of the last `keep` versions uses, and the versions before these. Run it while nothing is written: a commit not yet published is unused."""
    known = versions.numbers(spark, path)
    used = {f.commit for n in known[-keep:] for f in _version(spark, path, n).folders}
    return versions.remove(spark, path, used, known[:-keep])


def json_records(rows: DataFrame) -> DataFrame:
    """One JSON text per row, dates in ISO form with time and zone."""
    options = {"dateFormat": "yyyy-MM-dd'T00:00:00.000Z'", "ignoreNullFields": "false"}
    return rows.select("tid", F.to_json(F.struct(*rows.columns), options).alias("record"))


def export_json(rows: DataFrame, path: str) -> None:
    """The same records as JSON lines."""
    (rows.write.mode("overwrite").option("ignoreNullFields", "false")
     .option("dateFormat", "yyyy-MM-dd'T00:00:00.000Z'").json(path))
