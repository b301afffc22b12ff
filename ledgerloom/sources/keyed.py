"""Stored tables with one row per key: schedules by id, budgets by account and subject.

The rows lie in lots by a hash of the key, so a lot holds a share of all accounts, and one account's rows are spread like any other's. A change
writes the lots it touches anew and publishes a version (`versions`): readers see all of a change or nothing, and earlier versions
stay readable. A version can note the run that made it, so that a step over two stores is repeated without harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.schema import BUDGETS, SCHEDULES
from ledgerloom.sources import versions
from ledgerloom.sources.versions import Folder, Version


class KeysTwice(ValueError):
    """Rows given for one key more than once."""


@dataclass(frozen=True)
class Keyed:
    """The columns stored and those that are the key."""

    schema: T.StructType
    keys: tuple[str, ...]


SCHEDULE_STORE = Keyed(SCHEDULES, ("id",))
BUDGET_STORE = Keyed(BUDGETS, ("account_id", "subject"))
# Rows of a lot when a store is created.
LOT_ROWS = 5_000_000


@dataclass(frozen=True)
class KeyedStore:
    spark: SparkSession
    path: str
    kind: Keyed

    def version(self, number: int | None = None) -> Version:
        found = versions.read(self.spark, self.path, number)
        if found is None:
            raise FileNotFoundError(f"{self.path} is no store" if number is None else f"{self.path} has no version {number}")
        return found

    def create(self, rows: DataFrame, lots: int | None = None) -> Version:
        """A new store. Without a number of lots it follows from the number of rows."""
        if versions.numbers(self.spark, self.path):
            raise versions.StoreChanged(f"{self.path} is a store already")
        rows = self._shaped(rows)
        self._refuse_twice(rows)
        lots = lots or max(1, -(-rows.count() // LOT_ROWS))
        return versions.publish(self.spark, self.path, Version(0, runs={"lots": lots}, folders=tuple(self._write(rows, lots))))

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.version(version).folders)

    def upsert(self, rows: DataFrame, run: str | None = None) -> list[Folder]:
        """Whole rows stored under their keys, in place of what is there. Returns the folders replaced."""
        rows = self._shaped(rows)
        self._refuse_twice(rows)
        return self.change(rows, lambda held: held.join(rows.select(*self.kind.keys), self._same(rows, held), "left_anti").unionByName(rows), run)

    def delete(self, keys: DataFrame, run: str | None = None) -> list[Folder]:
        return self.change(keys, lambda held: held.join(keys.select(*self.kind.keys), self._same(keys, held), "left_anti"), run)

    def change(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], run: str | None = None) -> list[Folder]:
        """The lots of the given keys made anew by `change`, which gets all their rows and may change or add only
        rows with these keys. With a run that the store has noted already, nothing is done."""
        version = self.version()
        if run is not None and f"run {run}" in version.runs:
            return []
        lots = version.runs["lots"]
        # At most one value per lot.
        touched = {r[0] for r in keys.select(self._lot(lots).alias("lot")).distinct().collect()}
        old = [f for f in version.folders if f.lot in touched]
        new = self._write(self._shaped(change(self._read(old))), lots) if touched else []
        if not touched and run is None:
            return []
        after = replace(version.without(old).with_folders(new), runs=version.runs | ({f"run {run}": version.number} if run is not None else {}))
        versions.publish(self.spark, self.path, after)
        return old

    def _lot(self, lots: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast(self.kind.schema[k].dataType) for k in self.kind.keys]), F.lit(lots)).cast("string")

    def _same(self, new: DataFrame, held: DataFrame) -> Column:
        same = F.lit(True)
        for k in self.kind.keys:
            same = same & held[k].eqNullSafe(new[k])
        return same

    def _shaped(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in self.kind.schema.fields])

    def _refuse_twice(self, rows: DataFrame) -> None:
        twice = rows.groupBy(*self.kind.keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").first()
        if twice is not None:
            raise KeysTwice(f"more than one row for {twice.asDict()}")

    def _read(self, folders: Iterable[Folder]) -> DataFrame:
        paths = [f"{self.path}/{f.path}" for f in folders]
        if not paths:
            return self.spark.createDataFrame([], self.kind.schema)
        return self.spark.read.schema(self.kind.schema).parquet(*paths)

    def _write(self, rows: DataFrame, lots: int) -> list[Folder]:
        commit, names = uuid.uuid4().hex, self.kind.schema.fieldNames()
        placed = rows.select(*names, F.lit(None).cast("int").alias("year"), self._lot(lots).alias("lot"))
        (placed.hint("rebalance", F.col("lot")).sortWithinPartitions("lot", "account_id")
         .write.partitionBy("year", "lot").parquet(f"{self.path}/commit={commit}"))
        whole = T.StructType([*self.kind.schema.fields, T.StructField("year", T.IntegerType()), T.StructField("lot", T.StringType())])
        found = self.spark.read.schema(whole).parquet(f"{self.path}/commit={commit}").groupBy("lot").agg(
            F.count(F.lit(1)).alias("rows"), F.min("account_id").alias("first_account"), F.max("account_id").alias("last_account"))
        # One row per lot.
        return [Folder(commit=commit, year=None, batch="keyed", first_id=0, last_id=0, first_date=None, last_date=None, **r.asDict())
                for r in found.collect()]


def schedules_at(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, SCHEDULE_STORE)


def budgets_at(spark: SparkSession, path: str) -> KeyedStore:
    return KeyedStore(spark, path, BUDGET_STORE)
