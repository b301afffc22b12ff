"""Schemas and fixed names shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
MISSING = "not provided"

LEDGER = T.StructType([
    T.StructField("tid", T.LongType()),
    T.StructField("account_id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("amount", MONEY),
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("status", T.BooleanType()),
    T.StructField("payee", T.StringType()),
])

STAGING = T.StructType([
    T.StructField("tid", T.LongType()),
    T.StructField("account_id", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("amount", MONEY),
    T.StructField("type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("beneficiary", T.StringType()),
])

SCHEDULES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("account_id", T.LongType()),
    T.StructField("frequency", T.StringType()),
    T.StructField("interval_n", T.IntegerType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("active", T.BooleanType()),
    T.StructField("last_approved", T.DateType()),
    T.StructField("amount", MONEY),
    T.StructField("description", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("payee", T.StringType()),
])

BUDGETS = T.StructType([
    T.StructField("account_id", T.LongType()),
    T.StructField("subject", T.StringType()),
    T.StructField("limit_amount", MONEY),
    T.StructField("last_month", MONEY),
    T.StructField("avg_month", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("apply", T.BooleanType()),
])

# What makes two ledger rows of one account the same purchase.
NATURAL_KEY = ["account_id", "date", "amount", "type", "description", "category", "subcategory"]
SUBJECTS = ["tag", "category", "subcategory"]
