"""What every rewrite rule makes of its texts, written out."""

from __future__ import annotations

from ledgerloom.operators import taxonomy

# Category and subcategory before, and after.
REWRITTEN = """
Wage & Salary : Net Pay > Salary : Monthly Fixed
Wage & Salary : Overtime > Salary : Bonus
Wage & Salary : x > Salary : x
Automobile : Car Payment > Mobility : EMI
Automobile : Gasoline > Mobility : Fueling
Automobile : Insurance > Mobility : Monthly Fixed
Automobile : Parking > Mobility : Monthly Fixed
Automobile : x > Mobility : x
Groceries : x > Household : Groceries
Bills : Cable/Satellite Television > Bills : Television
Bills : Cell Phone > Bills : Telephone
Bills : On-line/Internet Service > Bills : Internet Services
Bills : Water & Sewer > Bills : Utilities
Bills : Garbage & Recycle > Bills : Utilities
Bills : Health Club > Bills : Membership Fees
Bills : x > Bills : x
Baby : Medicare > Household : Medicines
Baby : Entertainment > Household : Accessories
Baby : Fees > Household : Membership
Baby : x > Household : x
Bank Charges : Service charge > Finances : Fees
Bank Charges : x > Finances : x
Credit Card Payments/Transfers : x > Bills : Reimbursement
Clothing : x > Personal : Clothing
Deposit : x > Finances : Deposits
Dining Out : x > Leisure : Dining Out
Education : Tuition > Education : Fees
Education : x > Education : x
Entertainment : x > Leisure : x
Food : x > Leisure : Dining Out
Gift : x > Leisure : Gifts
Gifts : x > Leisure : Gifts
Other Income : x > Other Income : Gifts
Hobbies/Leisure : Books & Magazines > Leisure : Books
Hobbies/Leisure : Cultural Events > Leisure : Events
Hobbies/Leisure : Movies & Video Rentals > Leisure : Events
Hobbies/Leisure : Sporting Events > Leisure : Events
Hobbies/Leisure : Sporting Goods > Leisure : Clothing
Hobbies/Leisure : x > Leisure : x
Fees : x > Uncategorized : x
Happy : x > Uncategorized : x
Health-care : x > Healthcare : x
Home Improvement : x > Household : x
Insurance : Automobile > Mobility : Insurance
Mobility : Automobile > Mobility : Insurance
Insurance : Health > Healthcare : Insurance
Healthcare : Health > Healthcare : Insurance
Insurance : x > Healthcare : Insurance
Investment Income : x > Investment : Interest
x : Loan Interest > x : Interest
x : Mortgage Interest > x : Interest
x : Student Loan Interest > x : Interest
Not an Expense : x > Funds Transfer : x
Personal Care : x > Personal : Medicines
Travel/Vacation : Food > Travel : Food
Travel/Vacation : Lodging > Travel : Hotel
Travel/Vacation : Travel > Travel : Fare
Travel/Vacation : x > Travel : x
Utilities : x > Bills : Utilities
x : x > x : x
"""


def test_every_rule(spark):
    cases = [[tuple(side.strip().split(" : ")) for side in line.split(" > ")] for line in REWRITTEN.strip().splitlines()]
    rows = spark.createDataFrame([(i, *before) for i, (before, _) in enumerate(cases)], "n int, category string, subcategory string")
    found = taxonomy.reformat_taxonomy(rows).orderBy("n").collect()
    assert [(r.category, r.subcategory) for r in found] == [after for _, after in cases]
