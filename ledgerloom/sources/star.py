"""The ledger's tables as views over a star schema of parquet tables.

Every function takes (spark, folder) and reads only the columns and tables its
caller asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.schema import LEDGER, MONEY


# Given, so that no job has to look for them in the files.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_returnflag string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("account_id"),
        F.col("c_name").alias("name"),
        F.col("c_custkey").cast("int").alias("number"),
        F.concat(F.lit("user_"), F.col("c_nationkey").cast("string")).alias("holder"),
        F.col("c_mktsegment").alias("currency"),
        F.col("c_acctbal").cast(MONEY).alias("balance"),
    )


def openings(spark: SparkSession, folder: str) -> DataFrame:
    return accounts(spark, folder).select("account_id", F.col("balance").alias("opening"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        F.concat(F.lit("user_"), F.col("n_nationkey").cast("string")).alias("username"),
        F.concat(F.col("n_name"), F.lit("@example.org")).alias("email"),
        (F.col("n_regionkey") == 0).alias("is_admin"),
    )


_FROM_LINES = {
    "description": ("part", "p_name"),
    "category": ("part", "p_type"),
    "subcategory": ("part", "p_brand"),
    "payee": ("supplier", "s_name"),
    "tag": (None, "l_returnflag"),
}


def _line_facts(spark: SparkSession, folder: str, wanted: list[str]) -> DataFrame:
    """Per order: its lowest part and supplier looked up, and its lowest return flag."""
    sources = {_FROM_LINES[c][0] for c in wanted}
    minima = []
    if "part" in sources:
        minima.append(F.min("l_partkey").alias("p_partkey"))
    if "supplier" in sources:
        minima.append(F.min("l_suppkey").alias("s_suppkey"))
    if None in sources:
        # A flag is one character; its code aggregates by hash, text only by sorting.
        minima.append(F.char(F.min(F.ascii("l_returnflag"))).alias("l_returnflag"))
    facts = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("tid")).agg(*minima)
    # Looked up here, before the outer join, where the keys are never null.
    if "part" in sources:
        facts = facts.join(table(spark, folder, "part"), "p_partkey", "left")
    if "supplier" in sources:
        facts = facts.join(table(spark, folder, "supplier"), "s_suppkey", "left")
    return facts.select("tid", *[F.col(_FROM_LINES[c][1]).alias(c) for c in wanted])


def ledger(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One ledger row per order. Naming columns skips the joins of the others."""
    columns = list(columns) or LEDGER.fieldNames()
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("tid"),
        F.col("o_custkey").alias("account_id"),
        F.to_date("o_orderdate").alias("date"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))
        .otherwise(-F.col("o_totalprice")).cast(MONEY).alias("amount"),
        F.col("o_orderpriority").alias("type"),
        F.col("o_orderstatus").isin("F", "O").alias("status"),
    )
    wanted = [c for c in columns if c in _FROM_LINES]
    if wanted:
        orders = orders.join(_line_facts(spark, folder, wanted), "tid", "left")
    return orders.select(*columns)


def schedules(spark: SparkSession, folder: str) -> DataFrame:
    """One recurring payment per part."""
    key, size = F.col("p_partkey"), F.col("p_size")
    first = F.lit("2000-01-01").cast("date")
    shift = (key % 60).cast("int")
    return table(spark, folder, "part").select(
        key.alias("id"),
        (key % 100).alias("account_id"),
        F.when(key % 3 == 0, "Monthly").when(key % 3 == 1, "Weekly").otherwise("Yearly").alias("frequency"),
        (1 + size % 3).cast("int").alias("interval_n"),
        (1 + key % 31).cast("int").alias("day"),
        F.date_add(first, shift).alias("start_date"),
        F.date_add(first, shift + 20 * size).alias("end_date"),
        (size % 5 != 0).alias("active"),
        F.lit(None).cast("date").alias("last_approved"),
        (-F.col("p_retailprice")).cast(MONEY).alias("amount"),
        F.col("p_name").alias("description"),
        F.lit("Electronic payment").alias("type"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.lit("Routine").alias("tag"),
        F.lit("not provided").alias("payee"),
    )


def budgets(spark: SparkSession, folder: str, subject: str = "category") -> DataFrame:
    """A budget for each subject an account has booked, for three of the currencies;
    the other accounts have none."""
    booked = ledger(spark, folder, "account_id", subject).where(F.col(subject).isNotNull()).distinct()
    holders = accounts(spark, folder).where(F.col("currency").isin("AUTOMOBILE", "BUILDING", "MACHINERY"))
    return booked.join(holders, "account_id").select(
        "account_id",
        F.col(subject).alias("subject"),
        F.lit("100000.00").cast(MONEY).alias("limit_amount"),
        F.lit("0").cast(MONEY).alias("last_month"),
        F.lit("0").cast("decimal(18,6)").alias("avg_month"),
        F.col("currency").alias("unit"),
        (F.col("balance") >= 5000).alias("apply"),
    )


def homebank_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows as a home-banking tool exports them: text, with gaps."""
    tid = F.col("tid")
    return ledger(spark, folder).select(
        tid.alias("pos"),
        "account_id",
        F.when(tid % 3 == 0, F.date_format("date", "d/M/yyyy")).otherwise(F.date_format("date", "dd/MM/yyyy")).alias("date"),
        (tid % 12).cast("int").alias("paymode"),
        F.when(tid % 7 == 0, None).otherwise(F.col("payee")).alias("payee"),
        F.col("description").alias("wording"),
        F.col("amount").cast("string").alias("amount"),
        F.when(tid % 6 == 0, "Automobile:Insurance").when(tid % 6 == 1, "Insurance:Automobile")
        .when(tid % 6 == 2, "Food").when(tid % 6 == 3, "Bills:Cell Phone")
        .when(tid % 6 == 4, "Utilities:").alias("category"),
        F.col("tag").alias("tags"),
    )


def statement_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger rows as a bank statement lists them: text, with stray marks."""
    tid, amount = F.col("tid"), F.col("amount")
    return ledger(spark, folder).select(
        tid.alias("pos"),
        "account_id",
        F.when(tid % 89 == 5, F.date_format("date", "dd.MM.yy")).when(tid % 4 == 0, F.date_format("date", "M/d/yyyy"))
        .when(tid % 4 == 1, F.date_format("date", "yyyy-MM-dd")).otherwise(F.date_format("date", "MM/dd/yyyy")).alias("value_date"),
        F.when(tid % 6 == 0, "Cash withdrawal").when(tid % 6 == 1, "Credit Transfer")
        .when(tid % 6 == 2, "Debit Card Payment").when(tid % 6 == 3, "Standing Order")
        .when(tid % 6 == 4, "SEPA Direct Debit").otherwise("Fee").alias("transaction_type"),
        F.when(tid % 11 == 0, "0").when(amount < 0, amount.cast("string")).alias("debit"),
        F.when(tid % 13 == 0, "n/a")
        .when((tid % 11 != 0) & (amount > 0), F.concat(amount.cast("string"), F.lit('",'))).alias("credit"),
        F.col("description").alias("payment_details"),
        F.col("payee").alias("beneficiary"),
    )
