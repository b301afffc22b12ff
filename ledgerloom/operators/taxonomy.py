"""Rewrite of a home-banking tool's categories into the ledger's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C, S = "category", "subcategory"

# The rewrite rules, in order. (category, subcategory, column, new
# value); None matches anything. Each rule sees the outcome of the ones before.
RULES = [
    ("Wage & Salary", "Net Pay", S, "Monthly Fixed"),
    ("Wage & Salary", "Overtime", S, "Bonus"),
    ("Wage & Salary", None, C, "Salary"),
    ("Automobile", "Car Payment", S, "EMI"),
    ("Automobile", "Gasoline", S, "Fueling"),
    ("Automobile", "Insurance", S, "Monthly Fixed"),
    ("Automobile", "Parking", S, "Monthly Fixed"),
    ("Automobile", None, C, "Mobility"),
    ("Groceries", None, S, "Groceries"),
    ("Groceries", None, C, "Household"),
    ("Bills", "Cable/Satellite Television", S, "Television"),
    ("Bills", "Cell Phone", S, "Telephone"),
    ("Bills", "On-line/Internet Service", S, "Internet Services"),
    ("Bills", "Water & Sewer", S, "Utilities"),
    ("Bills", "Garbage & Recycle", S, "Utilities"),
    ("Bills", "Health Club", S, "Membership Fees"),
    ("Baby", "Medicare", S, "Medicines"),
    ("Baby", "Entertainment", S, "Accessories"),
    ("Baby", "Fees", S, "Membership"),
    ("Baby", None, C, "Household"),
    ("Bank Charges", "Service charge", S, "Fees"),
    ("Bank Charges", None, C, "Finances"),
    ("Credit Card Payments/Transfers", None, S, "Reimbursement"),
    ("Credit Card Payments/Transfers", None, C, "Bills"),
    ("Clothing", None, S, "Clothing"),
    ("Clothing", None, C, "Personal"),
    ("Deposit", None, S, "Deposits"),
    ("Deposit", None, C, "Finances"),
    ("Dining Out", None, S, "Dining Out"),
    ("Dining Out", None, C, "Leisure"),
    ("Education", "Tuition", S, "Fees"),
    ("Entertainment", None, C, "Leisure"),
    ("Food", None, S, "Dining Out"),
    ("Food", None, C, "Leisure"),
    ("Gift", None, S, "Gifts"),
    ("Gifts", None, S, "Gifts"),
    ("Gift", None, C, "Leisure"),
    ("Gifts", None, C, "Leisure"),
    ("Other Income", None, S, "Gifts"),
    ("Hobbies/Leisure", "Books & Magazines", S, "Books"),
    ("Hobbies/Leisure", "Cultural Events", S, "Events"),
    ("Hobbies/Leisure", "Movies & Video Rentals", S, "Events"),
    ("Hobbies/Leisure", "Sporting Events", S, "Events"),
    ("Hobbies/Leisure", "Sporting Goods", S, "Clothing"),
    ("Hobbies/Leisure", None, C, "Leisure"),
    ("Fees", None, C, "Uncategorized"),
    ("Happy", None, C, "Uncategorized"),
    ("Health-care", None, C, "Healthcare"),
    ("Home Improvement", None, C, "Household"),
    ("Insurance", "Automobile", C, "Mobility"),
    ("Mobility", "Automobile", S, "Insurance"),
    ("Insurance", "Health", C, "Healthcare"),
    ("Healthcare", "Health", S, "Insurance"),
    ("Insurance", None, S, "Insurance"),
    ("Insurance", None, C, "Healthcare"),
    ("Investment Income", None, S, "Interest"),
    ("Investment Income", None, C, "Investment"),
    (None, "Loan Interest", S, "Interest"),
    (None, "Mortgage Interest", S, "Interest"),
    (None, "Student Loan Interest", S, "Interest"),
    ("Not an Expense", None, C, "Funds Transfer"),
    ("Personal Care", None, S, "Medicines"),
    ("Personal Care", None, C, "Personal"),
    ("Travel/Vacation", "Food", S, "Food"),
    ("Travel/Vacation", "Lodging", S, "Hotel"),
    ("Travel/Vacation", "Travel", S, "Fare"),
    ("Travel/Vacation", None, C, "Travel"),
    ("Utilities", None, S, "Utilities"),
    ("Utilities", None, C, "Bills"),
]


def outcomes() -> list[tuple[str | None, str | None, str | None, str | None]]:
    """What the rules make of every pair they can tell apart.

    A value no rule mentions stands as None on both sides. The rules only compare
    with constants, so this table holds the whole effect of the ordered list and
    its size depends on the list alone.
    """
    categories = {None, *(r[0] for r in RULES)}
    subcategories = {None, *(r[1] for r in RULES)}
    table = []
    for category in categories:
        for subcategory in subcategories:
            now = {C: category, S: subcategory}
            for if_category, if_subcategory, column, value in RULES:
                if if_category in (None, now[C]) and if_subcategory in (None, now[S]):
                    now[column] = value
            table.append((category, subcategory, now[C], now[S]))
    return table


def reformat_taxonomy(rows: DataFrame) -> DataFrame:
    """Both columns rewritten, by one join with the small table of outcomes."""
    known = [{r[i] for r in RULES if r[i] is not None} for i in (0, 1)]

    def told(name: str, values: set[str]) -> Column:
        return F.when(F.col(name).isin(sorted(values)), F.col(name)).otherwise(F.lit(""))

    table = rows.sparkSession.createDataFrame(
        [(c or "", s or "", to_c, to_s) for c, s, to_c, to_s in outcomes()],
        "told_c string, told_s string, to_c string, to_s string")
    told_rows = rows.withColumns({"told_c": told(C, known[0]), "told_s": told(S, known[1])})
    return (told_rows.join(F.broadcast(table), ["told_c", "told_s"], "left")
            .withColumns({C: F.coalesce("to_c", C), S: F.coalesce("to_s", S)})
            .select(*rows.columns))
