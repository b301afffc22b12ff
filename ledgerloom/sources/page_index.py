"""Ordered rows kept for paging: any page of a sorted and filtered table without sorting it again.

`build` writes the rows that pass a request's filters once, in its order: every task's range of the order is a part, and each row has its place in
its part. The list of parts with their numbers of rows is written last, so a reader sees a whole index or none. A page is then read from the
parts that hold it, and inside these by the place, which Parquet's statistics cut to the row groups. The driver holds one number per part.

An index belongs to the filters and the order of its request, and to the version of the rows, if one is named: it refuses others.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.table_query import TableQuery

PART, PLACE = "__part", "__place"
PLACE_BITS = 33
PARTS = "part int, n long, signature string, version long, columns string"


class OtherRequest(ValueError):
    """The index is of other filters, another order or another version of the rows."""


def signature(query: TableQuery) -> str:
    """What a request's ordered rows depend on, besides the rows: not the page."""
    asked = query.request
    dated = any("date" in query.columns[i].search_method for i in query.filters)
    return json.dumps([
        sorted((i, v) for i, v in asked.searches.items() if i in query.filters), asked.search, asked.regex, list(asked.order), query.unique,
        str(query.as_of) if dated else None, [(c.expr, c.search_method, c.nulls_order, c.global_search) for c in query.columns]])


@dataclass(frozen=True)
class PageIndex:
    path: str
    signature: str
    version: int | None
    schema: T.StructType = field(repr=False)
    # Rows of each part, in order.
    sizes: tuple[int, ...] = ()

    @property
    def n_rows(self) -> int:
        return sum(self.sizes)

    def rows(self, spark: SparkSession, start: int = 0, length: int = -1) -> DataFrame:
        """The rows from place `start` on in order, `length` of them or all if negative; only the parts that hold them are opened."""
        end = self.n_rows if length < 0 else min(start + length, self.n_rows)
        before = [0, *accumulate(self.sizes)]
        held = [i for i, n in enumerate(self.sizes) if n and before[i] < end and before[i] + n > start]
        if not held:
            return spark.createDataFrame([], self.schema)
        first, last = held[0], held[-1]
        whole = T.StructType([*self.schema.fields, T.StructField(PLACE, T.LongType()), T.StructField(PART, T.IntegerType())])
        stored = spark.read.schema(whole).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/{PART}={i}" for i in held])
        if before[first] < start:
            stored = stored.where((F.col(PART) > first) | (F.col(PLACE) >= start - before[first]))
        if before[last + 1] > end:
            stored = stored.where((F.col(PART) < last) | (F.col(PLACE) < end - before[last]))
        return stored.orderBy(PART, PLACE).select(*self.schema.fieldNames())

    def page(self, query: TableQuery) -> DataFrame:
        """`TableQuery.page` from the index."""
        if signature(query) != self.signature:
            raise OtherRequest(f"the index at {self.path} has other filters or another order")
        return query.named(self.rows(query.rows.sparkSession, query.request.start, query.request.length))


def build(query: TableQuery, path: str, version: int | None = None) -> PageIndex:
    """Write the index of a request's filters and order to a new folder. `version` is that of the rows, as their store counts it."""
    spark, order = query.rows.sparkSession, query.ordering()
    ranged = query.filtered().repartitionByRange(*order).withColumn(PART, F.spark_partition_id()).sortWithinPartitions(PART, *order)
    # Ids of one task count its rows from 0, here in their order.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    ranged.withColumn(PLACE, place).write.partitionBy(PART).parquet(f"{path}/rows")
    stored = T.StructType([T.StructField(PLACE, T.LongType()), T.StructField(PART, T.IntegerType())])
    sizes = spark.read.schema(stored).parquet(f"{path}/rows").groupBy(F.col(PART).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    head = spark.createDataFrame([(None, 0, signature(query), version, query.rows.schema.json())], PARTS)
    lines = head.unionByName(sizes.where("n > 0"), allowMissingColumns=True)  # one row per part
    lines.coalesce(1).write.parquet(f"{path}/parts")
    return open_index(spark, path, version)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> PageIndex:
    """An index that was built, for a named version of the rows only if it is of that version."""
    lines = spark.read.schema(PARTS).parquet(f"{path}/parts").collect()
    (head,) = [r for r in lines if r.part is None]
    if version is not None and head.version != version:
        raise OtherRequest(f"the index at {path} is of version {head.version}")
    sizes = [0] * (1 + max((r.part for r in lines if r.part is not None), default=-1))
    for r in lines:
        if r.part is not None:
            sizes[r.part] = r.n
    return PageIndex(path, head.signature, head.version, T.StructType.fromJson(json.loads(head.columns)), tuple(sizes))
