"""A text index of a stored ledger: which files can hold a text, by three-character grams.

The index has, per searched column, every gram of the lower-cased texts and the files it occurs in. A text that is searched for can only be where all of its grams
are, so other files are not opened; the rows of those that are left go through the query's own filters, which decide. Folders of a store never change, so `catch_up`
reads the folders that are new and keeps what it has of the others. A folder that the index has not seen yet is searched whole: an index that is
behind costs time, never rows.

Searches without three characters in a row besides wildcards open every file. What the driver holds is one line per file that a search opens, and per folder of the store.
"""

from __future__ import annotations

import copy
import re
import uuid
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import clean_search_pattern
from ledgerloom.operators.table_query import TableQuery
from ledgerloom.schema import LEDGER
from ledgerloom.sources import stores, versions
from ledgerloom.sources.versions import Folder, Version

GRAM = 3
# The columns whose text can be searched.
INDEXED = [f.name for f in LEDGER.fields if f.name not in ("tid", "account_id", "status")]
POSTINGS = "column string, gram string, file string"
# How a text lies below its store.
PLACE = r"(commit=[^/]+/year=[^/]+/lot=[^/]+/[^/]+)$"
TEXT_METHODS = ["string_contains", "yadcf_text", "ilike", "like"]
# Lower case of these letters depends on the letters beside them.
UNSURE = "σς"


def _postings(spark: SparkSession, ledger: str, folders: Iterable[Folder]) -> DataFrame:
    rows = stores.with_files(spark, ledger, LEDGER, folders).select(*INDEXED, F.regexp_extract("file", PLACE, 1).alias("file"))
    texts = rows.select("file", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lower(F.col(c).cast("string")).alias("text")) for c in INDEXED])))
    # Equal texts of a file are many: they are cut into grams once.
    once = texts.where(F.length("text") >= GRAM).distinct()
    grams = F.transform(F.sequence(F.lit(1), F.length("text") - (GRAM - 1)), lambda at: F.substr("text", at, F.lit(GRAM)))
    return once.select("column", F.explode(F.array_distinct(grams)).alias("gram"), "file").distinct()


def catch_up(spark: SparkSession, ledger: str, path: str) -> list[Folder]:
    """Bring the index below `path` to the newest version of the ledger; returns the folders of the ledger it read."""
    now, index = versions.read(spark, ledger), versions.read(spark, path) or Version(0)
    if now is None:
        raise FileNotFoundError(f"{ledger} is no store")
    held, known = {f.path for f in now.folders}, {f.batch for f in index.folders}
    new = [f for f in now.folders if f.path not in known]
    stay = tuple(f for f in index.folders if f.batch in held)
    if not new and len(stay) == len(index.folders) and index.number:
        return []
    commit = uuid.uuid4().hex
    if new:
        # Ordered by gram, so that a search reads the row groups of its own.
        (_postings(spark, ledger, new).repartitionByRange("gram", "column", "file").sortWithinPartitions("gram", "column", "file")
         .write.parquet(f"{path}/commit={commit}"))
    # One line per folder of the ledger: its path, and the commit that has its grams.
    lines = [Folder(commit, None, "postings", f.path, f.rows, 0, 0, 0, 0, None, None) for f in new]
    versions.publish(spark, path, replace(index, folders=(*stay, *lines)))
    return new


def _grams(piece: str) -> set[str]:
    found = {piece[i:i + GRAM] for i in range(len(piece) - GRAM + 1)}
    return {g for g in found if not set(g) & set(UNSURE)}


def _lowered(spark: SparkSession, texts: list[str]) -> list[str]:
    """As Spark's own comparison makes them."""
    return list(spark.range(1).select(F.array(*[F.lower(F.lit(t)) for t in texts])).first()[0]) if texts else []


def needles(query: TableQuery) -> list[list[tuple[list[str], set[str]]]]:
    """What the request's filters need: of each filter the ways to pass, each as the columns of which one must have all the grams.
    A filter that says nothing about grams is left out."""
    spark, asked = query.rows.sparkSession, query.request
    found: list[list[tuple[list[str], str, str]]] = [
        [([query.columns[i].expr], asked.searches[i], r"[%_]")] for i in query.filters if query.columns[i].search_method in TEXT_METHODS]
    if query.global_filter is not None:
        columns = [c.expr for c in query.columns if c.global_search]
        if query.as_regex:
            # A cleaned pattern is a choice of plain texts.
            parts = [re.sub(r"\\(.)", r"\1", p) for p in clean_search_pattern(asked.search).split("|")]
            found.append([(columns, p, r"(?!)") for p in parts])
        else:
            found.append([(columns, asked.search, r"[%_]")])
    low = iter(_lowered(spark, [text for ways in found for _, text, _ in ways]))
    cut = [[(columns, {g for piece in re.split(wild, next(low)) for g in _grams(piece)}) for columns, _, wild in ways] for ways in found]
    # One way without grams, or with a column that is not indexed, lets every file pass.
    return [ways for ways in cut if all(grams and set(columns) <= set(INDEXED) for columns, grams in ways)]


def files_for(spark: SparkSession, ledger: str, path: str, filters: list[list[tuple[list[str], set[str]]]]) -> list[str] | None:
    """The files of the ledger's newest version, and the folders not yet indexed, in which a row can pass all filters; None stands for all."""
    index, now = versions.read(spark, path), versions.read(spark, ledger)
    if index is None or not filters:
        return None
    held = {f.path for f in now.folders}
    commits = {f.commit for f in index.folders if f.batch in held}
    unseen = [f.path for f in now.folders if f.path not in {i.batch for i in index.folders}]
    if not commits:
        return unseen
    wanted = sorted({g for ways in filters for _, grams in ways for g in grams})
    postings = spark.read.schema(POSTINGS).parquet(*[f"{path}/commit={c}" for c in sorted(commits)]).where(F.col("gram").isin(wanted))
    by_file = postings.groupBy("file", "column").agg(F.collect_set("gram").alias("grams"))  # at most the grams asked for

    def passes(columns: list[str], grams: set[str]):
        has = F.size(F.array_except(F.array(*[F.lit(g) for g in sorted(grams)]), "grams")) == 0
        return F.bool_or(F.col("column").isin(columns) & has)

    tests = F.lit(True)
    for ways in filters:
        any_way = F.lit(False)
        for columns, grams in ways:
            any_way = any_way | passes(columns, grams)
        tests = tests & any_way
    found = by_file.groupBy("file").agg(tests.alias("passes")).where("passes").collect()  # one line per file to open
    return [*unseen, *sorted(r.file for r in found if r.file.rpartition("/")[0] in held)]


def narrowed(query: TableQuery, ledger: str, path: str) -> TableQuery:
    """The query of a stored ledger with only the files to read that can hold its texts: for its filtered and ordered rows and its pages.
    Counts and facets are of all rows: ask the query itself for them."""
    spark = query.rows.sparkSession
    files = files_for(spark, ledger, path, needles(query))
    if files is None:
        rows = stores.read_ledger(spark, ledger)
    elif not files:
        rows = spark.createDataFrame([], LEDGER)
    else:
        whole = T.StructType([*LEDGER.fields, *stores.PLACES])
        rows = stores.ledger_rows(spark.read.schema(whole).option("basePath", ledger).parquet(*[f"{ledger}/{f}" for f in files]))
    other = copy.copy(query)
    other.rows = rows
    return other
