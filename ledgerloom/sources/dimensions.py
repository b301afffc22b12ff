"""The three fixed dimensions and the frequency codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes and names that ledgers, uploads and forms refer to.
TYPES = {
    0: "Unknown", 1: "Credit card", 2: "Check", 3: "Cash", 4: "Transfer",
    5: "Internal transfer", 6: "Debit card", 7: "Standing order",
    8: "Electronic payment", 9: "Deposit",
}
CATEGORIES = {
    1: "Home", 2: "Household", 3: "Personal", 4: "Leisure", 5: "Mobility",
    6: "Healthcare", 7: "Holiday", 8: "Education", 9: "Professional", 10: "Social",
    11: "Taxes", 12: "Investment", 13: "Bills", 14: "Salary", 15: "Finances",
    16: "Uncategorized", 17: "Loan", 18: "Miscellaneous", 19: "Other Income",
    20: "Fund Transfer", 21: "Travel",
}
SUBCATEGORIES = {
    1: "Rent", 2: "EMI", 3: "Electricity", 4: "Utility", 5: "Groceries",
    6: "Toiletries", 7: "Accessories", 8: "Dining out", 9: "Furniture",
    10: "Equipments", 11: "Seasonal", 12: "Regular", 13: "Formal", 14: "Fashion",
    15: "Footwear", 16: "Entertainment", 17: "Hobbies", 18: "Gifts", 19: "Books",
    20: "Toys", 21: "Membership", 22: "Fare", 23: "Parking", 24: "Insurance",
    25: "Maintenance", 26: "Repair", 27: "Medicines", 28: "Hotel", 29: "Food",
    30: "Shopping", 31: "Activities", 32: "Reimbursement", 33: "Donation",
    34: "Deduction", 35: "Internet", 36: "Telephone", 37: "Equities", 38: "Funds",
    39: "Deposits", 40: "Fueling", 41: "Bonus", 42: "Television",
    43: "Internet Services", 44: "Clothing", 45: "Interest", 46: "Monthly Fixed",
    47: "Services",
}
FREQUENCIES = {1: "Yearly", 2: "Quarterly", 3: "Monthly", 4: "Weekly"}


def dimension(spark: SparkSession, entries: Mapping[int, str]) -> DataFrame:
    """A dimension as a small table (id, name)."""
    return spark.createDataFrame(list(entries.items()), "id int, name string")


def name_of(code: Column, entries: Mapping[int, str]) -> Column:
    """The name of a code, null if unknown: a literal map, so no join."""
    pairs = [F.lit(v) for item in entries.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), code.cast("int"))
