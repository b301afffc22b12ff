"""Large arrays of JSON records, read by many tasks.

A file with one array has no line ends to cut it at, but every record ends with a closing brace. The text source takes that brace as its line
separator, so a file is split by bytes like any other text and the pieces between braces come out in order inside each block. A brace may
also stand in a string or close an inner object: quotes and depth decide. Both run on from piece to piece, so they are added up in two
levels, inside each block and, with one row per block, over the blocks of a file. A piece that is a whole record is parsed where it is; only
records of several pieces are put together, by the number of records that ended before them.

Files are standard JSON in UTF-8: an array of objects, or one object. Anything else stops the read, also a file that is cut off, text between records
or after the array, and a field of another type than the schema's. An empty file has no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.plans.workspace import checkpointed

BLOCK = ["file", "block"]
# What an error begins with.
BROKEN = "MALFORMED_UPLOAD: not an array of JSON records: "


def _opening(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("{")))


def array_text(scan: DataFrame) -> DataFrame:
    """The pieces of a text scan, of files or of a stream, with `}` as its line separator, and where they are from."""
    return scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("_metadata.file_size").alias("size"), "value")


def _pieces(text: DataFrame) -> DataFrame:
    """Text between closing braces, with the quotes in it and the braces that open outside strings, should
    the piece begin outside a string (`out`) or inside one (`inn`). No escape has a brace, so none is cut in two."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    unquoted = F.regexp_replace("__bare", r'"[^"]*+"?', "")
    rest = F.regexp_replace(F.regexp_replace("__bare", r'^[^"]*+"?', ""), r'"[^"]*+"?', "")
    return text.withColumns({"pos": F.monotonically_increasing_id(), "__bare": bare}).withColumns({
        "quotes": F.length("__bare") - F.length(F.replace("__bare", F.lit('"'))),
        "out": _opening(unquoted), "inn": _opening(rest),
    }).drop("__bare")


def _earlier(value: Column, by: list[str], order: str) -> Column:
    """The sum over the rows before this one."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _moved(starts_inside: Column, ends_inside: Column) -> Column:
    return F.when(starts_inside, F.col("inn")).otherwise(F.col("out")) - F.when(ends_inside, 0).otherwise(1)


def _block_starts(pieces: DataFrame) -> DataFrame:
    """Per block: whether it begins inside a string, its depth there, and whether its file is whole. One row per block of a file."""
    sizes = pieces.groupBy(*BLOCK).agg(
        F.sum("quotes").alias("quotes"), F.max("size").alias("size"), F.sum(F.octet_length("value") + 1).alias("bytes"),
        F.sum("step_out").alias("moved_out"), F.sum("step_in").alias("moved_in"),
        F.bool_or((F.col("block") == 0) & (F.col("place") == 0) & F.col("value").rlike(r"^\s*\[")).alias("array"))
    inside = sizes.withColumn("inside", _earlier(F.col("quotes"), ["file"], "block") % 2 == 1)
    deep = inside.withColumn("moved", F.when(F.col("inside"), F.col("moved_in")).otherwise(F.col("moved_out")))
    of_file = Window.partitionBy("file")
    depth, missing = F.sum("moved").over(of_file), F.sum("bytes").over(of_file) - F.col("size")
    # A file ends after its last piece: the end of an array or blanks, taken as a piece that goes below the top,
    # or nothing at all, when the last byte closed an object. The source leaves out a byte order mark.
    whole = F.when(F.max("array").over(of_file), depth == -1).otherwise((depth == -1) | ((depth == 0) & missing.isin(0, -3)))
    return deep.select(*BLOCK, "inside", _earlier(F.col("moved"), ["file"], "block").alias("above"), whole.alias("whole"))


def _refuse(why: str, *shown: Column) -> Column:
    return F.raise_error(F.concat(F.lit(BROKEN + why), F.lit(" in "), F.col("file"), *shown))


def record_texts(text: DataFrame) -> DataFrame:
    """The records of `array_text`, as texts with their file and an increasing position."""
    odd, end = F.col("odd"), (F.col("odd").cast("int") + F.col("quotes")) % 2 == 1
    pieces = _pieces(text).withColumns({
        "odd": _earlier(F.col("quotes"), BLOCK, "pos") % 2 == 1,
        "place": F.row_number().over(Window.partitionBy(*BLOCK).orderBy("pos")) - 1,
    }).withColumn("odd_end", end).withColumns({"step_out": _moved(odd, F.col("odd_end")), "step_in": _moved(~odd, ~F.col("odd_end"))})
    # One shuffle, by block. Blocks must begin at the same bytes in all that follows, so the pieces are written once.
    pieces = checkpointed(pieces.withColumns({f"deep_{x}": _earlier(F.col(f"step_{x}"), BLOCK, "pos") for x in ("out", "in")}))

    def either(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}_in")).otherwise(F.col(f"{name}_out"))

    found = pieces.join(_block_starts(pieces), BLOCK).withColumns({
        "starts": odd != F.col("inside"), "ends": F.col("odd_end") != F.col("inside"),
        "depth": F.col("above") + either("deep")}).withColumn("after", F.col("depth") + either("step"))
    top, opens = (F.col("depth") == 0) & ~F.col("starts"), F.col("out") > 0
    first = (F.col("block") == 0) & (F.col("place") == 0)
    gap = F.substring_index("value", "{", 1)
    between = F.when(first, gap.rlike(r"^\s*\[?\s*$")).otherwise(gap.rlike(r"^\s*,\s*$"))
    tail = F.when(first, F.col("value").rlike(r"^\s*(\[\s*\])?\s*$")).otherwise(F.col("value").rlike(r"^\s*\]?\s*$"))
    # What follows a record's first brace; the last piece of a file is none.
    rest = F.when(top, F.substr("value", F.length(gap) + 1)).otherwise(F.col("value"))
    closed = (F.col("after") == 0) & ~F.col("ends")
    # One expression and one filter on it: separate conditions could be reordered, and rows dropped before they are refused.
    kind = (F.when(~F.col("whole"), _refuse("its end is missing"))
            .when(F.col("depth") < 0, _refuse("text after the end"))
            .when(top & opens & ~between, _refuse("text between records: ", F.left(gap, F.lit(80))))
            .when(top & ~opens & ~tail, _refuse("text that is no record: ", F.left("value", F.lit(80))))
            .when(top & ~opens, F.lit("end")).when(top & closed, F.lit("record")).otherwise(F.lit("part")))
    checked = found.select(*BLOCK, "pos", F.concat(rest, F.lit("}")).alias("text"), closed.alias("closed"), kind.alias("kind"))
    alone = checked.where("kind = 'record'").select("file", "pos", F.col("text").alias("record"))
    # Only records of several pieces meet: those of the kind that ended earlier number them.
    parts = checked.where("kind = 'part'")
    ended = parts.groupBy(*BLOCK).agg(F.count_if("closed").alias("n"))
    numbers = ended.select(*BLOCK, _earlier(F.col("n"), ["file"], "block").alias("before"))
    own = F.col("before") + _earlier(F.col("closed").cast("int"), BLOCK, "pos")
    several = parts.join(numbers, BLOCK).withColumn("number", own)
    joined = several.groupBy("file", "number").agg(
        F.min_by("pos", F.struct("block", "pos")).alias("pos"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "pos", "text"))), lambda p: p["text"]), "").alias("record"))
    return alone.unionByName(joined.select("file", "pos", "record"))


def records(text: DataFrame, schema: str) -> DataFrame:
    """The records of `array_text` as rows, with `file` and `pos`."""
    record = F.from_json("record", schema, {"mode": "FAILFAST"})
    return record_texts(text).select(record.alias("__record"), "file", "pos").select("__record.*", "file", "pos")


def read_array(spark: SparkSession, path: str, schema: str, pattern: str) -> DataFrame:
    """The records of all files below a path whose names fit the pattern, with `file` and `pos`."""
    scan = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    return records(array_text(scan), schema)
