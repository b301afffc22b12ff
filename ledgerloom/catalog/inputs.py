"""Inputs of the queries that need more than the ledger: dirty text, edits, files.

All of them are made by Spark from the whole given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.cleaning import statement_rows
from ledgerloom.operators.normalise import normalise_staging
from ledgerloom.operators.schedules import upcoming
from ledgerloom.plans.workspace import run_folder, stored
from ledgerloom.sources import star
from ledgerloom.sources.uploads import HOMEBANK_SCHEMA, STATEMENT_COLUMNS, STATEMENT_PREAMBLE

# Rows of one uploaded file.
FILE_ROWS = 20_000


def dirty_ledger(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("type")
    return star.ledger(spark, folder).select(
        "tid", "account_id",
        F.when(F.col("status"), F.col("date").cast("string")).otherwise("2150-01-01").alias("date"),
        F.when(kind == "3-MEDIUM", "n/a").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(kind == "5-LOW", "").otherwise(kind).alias("type"),
        F.when(kind == "2-HIGH", F.repeat("description", F.lit(20))).otherwise(F.col("description")).alias("description"),
        "category", "subcategory",
        F.when(F.col("tag") == "A", F.repeat("tag", F.lit(65))).otherwise(F.col("tag")).alias("tag"),
        F.when(kind == "1-URGENT", None).otherwise(F.col("status")).alias("status"),
        "payee",
    )


def dirty_staging(spark: SparkSession, folder: str) -> DataFrame:
    cash = F.col("type") == "Cash"
    return statement_rows(star.statement_raw(spark, folder)).select(
        F.col("pos").alias("tid"), "account_id", "date", "amount", "type",
        F.when(cash, F.repeat("description", F.lit(20))).otherwise(F.col("description")).alias("description"),
        F.when(cash, "").otherwise(F.col("beneficiary")).alias("beneficiary"))


def staging(spark: SparkSession, folder: str, as_of) -> DataFrame:
    rows = statement_rows(star.statement_raw(spark, folder)).withColumnRenamed("pos", "tid")
    return normalise_staging(rows, as_of).select(
        "tid", "account_id", "date", "amount", "type", "description", "beneficiary")


def staged_twice(spark: SparkSession, folder: str, as_of) -> DataFrame:
    once = stored(staging(spark, folder, as_of), "once")
    greatest = once.agg(F.max("tid")).scalar()
    return once.unionByName(once.withColumn("tid", F.col("tid") + greatest + 1))


def dirty_schedules(spark: SparkSession, folder: str) -> DataFrame:
    category = F.col("category")
    return star.schedules(spark, folder).select(
        "id", "account_id",
        F.when(F.col("frequency") == "Weekly", "").otherwise(F.col("frequency")).alias("frequency"),
        F.when(F.col("interval_n") == 1, "x").otherwise(F.col("interval_n").cast("string")).alias("interval_n"),
        F.when(category == "PROMO", None).otherwise(F.col("day").cast("string")).alias("day"),
        F.col("start_date").cast("string").alias("start_date"),
        F.when(category == "ECONOMY", "1850-01-01").otherwise(F.col("end_date").cast("string")).alias("end_date"),
        F.when(category == "SMALL", None).otherwise(F.col("active")).alias("active"),
        F.when(category == "LARGE", "2200-01-01").alias("last_approved"),
        F.when(category == "SMALL", "n/a").otherwise(F.col("amount").cast("string")).alias("amount"),
        "description", "type", "category", "subcategory",
        F.when(category == "MEDIUM", F.repeat("tag", F.lit(20))).otherwise(F.col("tag")).alias("tag"),
        "payee")


def dirty_budgets(spark: SparkSession, folder: str) -> DataFrame:
    machines = F.col("unit") == "MACHINERY"
    return star.budgets(spark, folder).select(
        "account_id", "subject",
        F.when(machines, "n/a").otherwise(F.col("limit_amount").cast("string")).alias("limit_amount"),
        F.col("last_month").cast("string").alias("last_month"),
        F.lit("n/a").alias("avg_month"),
        F.when(F.col("unit") == "BUILDING", F.repeat("unit", F.lit(20))).otherwise(F.col("unit")).alias("unit"),
        F.when(machines, None).otherwise(F.col("apply")).alias("apply"))


def raw_accounts(spark: SparkSession, folder: str) -> DataFrame:
    holder, name = F.col("holder"), F.col("name")
    return star.accounts(spark, folder).select(
        "account_id",
        F.when(holder == "user_0", "").when(holder == "user_1", F.repeat("name", F.lit(10))).otherwise(name).alias("name"),
        F.when(holder == "user_2", F.concat(F.lit("A"), F.col("number").cast("string")))
        .otherwise(F.col("number").cast("string")).alias("number"),
        F.when(holder == "user_3", None).otherwise(F.col("currency")).alias("currency"),
        F.when(holder.isin("user_3", "user_4"), "n/a").otherwise(F.col("balance").cast("string")).alias("balance"))


def raw_users(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("username")
    return star.users(spark, folder).select(
        F.when(name == "user_1", "user 1").when(name == "user_2", F.repeat("username", F.lit(20)))
        .otherwise(name).alias("username"),
        F.when(name.isin("user_1", "user_3"), "nobody").when(name == "user_4", None)
        .otherwise(F.col("email")).alias("email"))


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """Form entries with codes, some of them unknown."""
    tid = F.col("tid")
    return star.ledger(spark, folder, "tid", "account_id", "date", "amount", "description", "tag", "status", "payee").select(
        "account_id", "tid", "date", "amount", (tid % 11).cast("int").alias("type_id"), "description",
        (1 + tid % 22).cast("int").alias("category_id"), (1 + tid % 48).cast("int").alias("subcategory_id"),
        (1 + tid % 5).cast("int").alias("frequency_id"))


def ledger_edits(spark: SparkSession, folder: str) -> DataFrame:
    return edits_of(star.ledger(spark, folder))


def edits_of(rows: DataFrame) -> DataFrame:
    """Two rounds of edits of the open rows; the second only of incomes."""
    first = rows.where(~F.col("status")).select(
        "account_id", "tid", F.lit(1).alias("seq"), F.date_add("date", 1).alias("date"),
        (F.col("amount") * 2).cast("decimal(18,2)").alias("amount"), "type", "description", "category",
        F.lit("edited").alias("subcategory"), F.concat(F.lit("  "), F.col("tag")).alias("tag"),
        (F.col("amount") < 0).alias("status"), "payee")
    second = first.where(F.col("amount") > 0).withColumns({
        "seq": F.lit(2), "status": F.lit(None).cast("boolean"), "payee": F.lit("second")})
    return first.unionByName(second)


def staging_edits(spark: SparkSession, folder: str, as_of) -> DataFrame:
    return staging(spark, folder, as_of).where(F.col("type") == "Cash").withColumns({
        "amount": (-F.col("amount")).cast("decimal(18,2)"), "beneficiary": F.lit("edited")})


def account_edits(spark: SparkSession, folder: str) -> DataFrame:
    """Overdrawn accounts start at 0; all machinery accounts are sent unchanged or so."""
    low = F.col("balance") < 0
    return star.accounts(spark, folder).where(low | (F.col("currency") == "MACHINERY")).select(
        "account_id", "name", "currency", F.when(low, 0).otherwise(F.col("balance")).alias("balance"))


def schedule_edits(spark: SparkSession, folder: str) -> DataFrame:
    return star.schedules(spark, folder).where(~F.col("active")).withColumns({
        "active": F.lit(True), "interval_n": F.col("interval_n") + 1, "tag": F.lit("ignored"),
        "payee": F.lit("edited")})


def budget_edits(spark: SparkSession, folder: str) -> DataFrame:
    """New limits where budgets apply, and a new budget for overdrawn accounts."""
    changed = star.budgets(spark, folder).where("apply").select(
        "account_id", "subject", F.lit("5000.00").cast("decimal(18,2)").alias("limit_amount"),
        "unit", F.lit(False).alias("apply"))
    added = star.accounts(spark, folder).where(F.col("balance") < 0).select(
        "account_id", F.lit("Leisure").alias("subject"),
        F.lit("250.00").cast("decimal(18,2)").alias("limit_amount"),
        F.col("currency").alias("unit"), F.lit(True).alias("apply"))
    return changed.unionByName(added)


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    """The larger upcoming payments are approved, the others move by a week."""
    approve = F.col("amount") < -950
    return upcoming(star.schedules(spark, folder)).select(
        "stid", approve.alias("approve"), F.when(~approve, F.date_add("date", 7)).alias("date"))


def _write_files(rows: DataFrame, value: Column, path: str) -> str:
    """One text file per FILE_ROWS ids; `value` makes a file's text of its rows."""
    files = rows.groupBy(F.floor(F.col("pos") / FILE_ROWS).alias("upload")).agg(value.alias("value"))
    files.write.partitionBy("upload").text(path)
    return path


def json_files(spark: SparkSession, folder: str) -> str:
    """JSON uploads: one array of records per file."""
    rows = star.ledger(spark, folder).withColumns({"pos": F.col("tid"), "closing_balance": F.lit(0.0)})
    record = F.to_json(F.struct(*[c for c in rows.columns if c != "pos"]), {"ignoreNullFields": "false"})
    array = F.concat(F.lit("["), F.array_join(F.collect_list(record), ",\n"), F.lit("]"))
    return _write_files(rows, array, run_folder(spark, "json"))


def homebank_files(spark: SparkSession, folder: str, path: str | None = None) -> str:
    """Home-banking exports, in a new folder or added to one; the free `info`
    column names the account."""
    rows = star.homebank_raw(spark, folder).withColumn("info", F.col("account_id"))
    path = path or run_folder(spark, "homebank")
    columns = [c.split(" ")[0] for c in HOMEBANK_SCHEMA.split(", ")]
    rows.select(*columns).write.mode("append").option("sep", ";").option("header", "true").csv(path)
    return path


def statement_files(spark: SparkSession, folder: str) -> str:
    """Statements: a preamble and a header before the rows. The customer reference
    names the account."""
    rows = star.statement_raw(spark, folder)
    names = list(STATEMENT_COLUMNS)
    fields = [F.coalesce(F.col(STATEMENT_COLUMNS[n]), F.lit("")) for n in names]
    line = F.concat_ws(";", *fields, F.col("account_id").cast("string"))
    head = [f"preamble {i}" for i in range(STATEMENT_PREAMBLE)] + [";".join([*names, "Customer Reference"])]
    text = F.concat(F.lit("\n".join(head) + "\n"), F.array_join(F.collect_list(line), "\n"))
    return _write_files(rows, text, run_folder(spark, "statements"))
