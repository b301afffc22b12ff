"""The ledger's tables as SQL views over the star schema, for the oracle."""

from __future__ import annotations

import re

VIEWS = {
    "accounts": """
        SELECT c_custkey AS account_id, c_name AS name, CAST(c_custkey AS INTEGER) AS number,
               'user_' || CAST(c_nationkey AS VARCHAR) AS holder, c_mktsegment AS currency,
               CAST(c_acctbal AS DECIMAL(18,2)) AS balance
        FROM customer""",
    "users": """
        SELECT 'user_' || CAST(n_nationkey AS VARCHAR) AS username, n_name || '@example.org' AS email,
               n_regionkey = 0 AS is_admin
        FROM nation""",
    "ledger": """
        SELECT o_orderkey AS tid, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date,
               CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE -o_totalprice END
                    AS DECIMAL(18,2)) AS amount,
               o_orderpriority AS type, p_name AS description, p_type AS category,
               p_brand AS subcategory, rf AS tag, o_orderstatus IN ('F','O') AS status, s_name AS payee
        FROM orders
        LEFT JOIN (SELECT l_orderkey, MIN(l_partkey) AS pk, MIN(l_suppkey) AS sk, MIN(l_returnflag) AS rf
                   FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
        LEFT JOIN part ON p_partkey = pk
        LEFT JOIN supplier ON s_suppkey = sk""",
    "done": "SELECT * FROM ledger WHERE status",
    "schedules": """
        SELECT p_partkey AS id, p_partkey % 100 AS account_id,
               CASE p_partkey % 3 WHEN 0 THEN 'Monthly' WHEN 1 THEN 'Weekly' ELSE 'Yearly' END AS frequency,
               CAST(1 + p_size % 3 AS INTEGER) AS interval_n, CAST(1 + p_partkey % 31 AS INTEGER) AS day,
               CAST(DATE '2000-01-01' + CAST(p_partkey % 60 AS INTEGER) AS DATE) AS start_date,
               CAST(DATE '2000-01-01' + CAST(p_partkey % 60 + 20 * p_size AS INTEGER) AS DATE) AS end_date,
               p_size % 5 <> 0 AS active, CAST(NULL AS DATE) AS last_approved,
               CAST(-p_retailprice AS DECIMAL(18,2)) AS amount, p_name AS description,
               'Electronic payment' AS type, p_type AS category, p_brand AS subcategory,
               'Routine' AS tag, 'not provided' AS payee
        FROM part""",
    # Brute force: every day of every schedule is tried.
    "due": """
        SELECT id, MIN(c) AS due FROM (
            SELECT id, frequency, interval_n, day, start_date,
                   CAST(UNNEST(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS c
            FROM schedules)
        WHERE day(c) = day AND CASE frequency
            WHEN 'Monthly' THEN ((year(c) - year(start_date)) * 12 + month(c) - month(start_date)) % interval_n = 0
            WHEN 'Yearly' THEN (year(c) - year(start_date)) % interval_n = 0
            ELSE (date_diff('day', date_trunc('week', start_date), date_trunc('week', c)) // 7) % interval_n = 0 END
        GROUP BY id""",
    "upcoming": """
        SELECT id AS stid, account_id, due AS date, amount, 'electronic' AS type, description, category,
               subcategory, tag, FALSE AS status, payee
        FROM schedules JOIN due USING (id) WHERE active AND due IS NOT NULL""",
    "decisions": """
        SELECT stid, amount < -950 AS approve,
               CASE WHEN amount < -950 THEN NULL ELSE CAST(date + 7 AS DATE) END AS date
        FROM upcoming""",
    "budgets": """
        SELECT DISTINCT account_id, category AS subject, CAST(100000 AS DECIMAL(18,2)) AS limit_amount,
               CAST(0 AS DECIMAL(18,2)) AS last_month, CAST(0 AS DECIMAL(18,6)) AS avg_month,
               currency AS unit, balance >= 5000 AS apply
        FROM ledger JOIN accounts USING (account_id)
        WHERE category IS NOT NULL AND currency IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""",
    "subbudgets": """
        SELECT DISTINCT account_id, subcategory AS subject, CAST(100000 AS DECIMAL(18,2)) AS limit_amount,
               CAST(0 AS DECIMAL(18,2)) AS last_month, CAST(0 AS DECIMAL(18,6)) AS avg_month,
               currency AS unit, balance >= 5000 AS apply
        FROM ledger JOIN accounts USING (account_id)
        WHERE subcategory IS NOT NULL AND currency IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""",
    "homebank_raw": """
        SELECT tid AS pos, account_id, CASE WHEN tid % 3 = 0 THEN strftime(date, '%-d/%-m/%Y') ELSE strftime(date, '%d/%m/%Y') END AS date, CAST(tid % 12 AS INTEGER) AS paymode,
               CASE WHEN tid % 7 = 0 THEN NULL ELSE payee END AS payee, description AS wording,
               CAST(amount AS VARCHAR) AS amount,
               CASE tid % 6 WHEN 0 THEN 'Automobile:Insurance' WHEN 1 THEN 'Insurance:Automobile'
                            WHEN 2 THEN 'Food' WHEN 3 THEN 'Bills:Cell Phone' WHEN 4 THEN 'Utilities:'
                            ELSE NULL END AS category, tag AS tags
        FROM ledger""",
    "homebank_clean": """
        SELECT pos, account_id, CAST(strptime(date, '%d/%m/%Y') AS DATE) AS date,
               CAST(amount AS DECIMAL(18,2)) AS amount, paymode AS type,
               COALESCE(wording, 'not provided') AS description,
               COALESCE(category, 'not provided') AS category, COALESCE(tags, 'not provided') AS tag,
               TRUE AS status, COALESCE(payee, 'not provided') AS payee
        FROM homebank_raw""",
    "homebank_split": """
        SELECT * REPLACE (string_split(category, ':')[1] AS category),
               COALESCE(NULLIF(string_split(category, ':')[2], ''), 'not provided') AS subcategory
        FROM homebank_clean""",
    "statement_raw": """
        SELECT tid AS pos, account_id, CASE WHEN tid % 89 = 5 THEN strftime(date, '%d.%m.%y') WHEN tid % 4 = 0 THEN strftime(date, '%-m/%-d/%Y')
                    WHEN tid % 4 = 1 THEN strftime(date, '%Y-%m-%d') ELSE strftime(date, '%m/%d/%Y') END AS value_date,
               CASE tid % 6 WHEN 0 THEN 'Cash withdrawal' WHEN 1 THEN 'Credit Transfer'
                            WHEN 2 THEN 'Debit Card Payment' WHEN 3 THEN 'Standing Order'
                            WHEN 4 THEN 'SEPA Direct Debit' ELSE 'Fee' END AS transaction_type,
               CASE WHEN tid % 11 = 0 THEN '0' WHEN amount < 0 THEN CAST(amount AS VARCHAR) END AS debit,
               CASE WHEN tid % 13 = 0 THEN 'n/a' WHEN tid % 11 <> 0 AND amount > 0
                    THEN CAST(amount AS VARCHAR) || '",' END AS credit,
               description AS payment_details, payee AS beneficiary
        FROM ledger""",
    "statement_money": """
        SELECT * FROM (
            SELECT *, CAST(TRY_CAST(replace(replace(COALESCE(debit, '0'), '",', ''), ',', '') AS DECIMAL(18,2))
                    + TRY_CAST(replace(replace(COALESCE(credit, '0'), '",', ''), ',', '') AS DECIMAL(18,2))
                    AS DECIMAL(18,2)) AS amount
            FROM statement_raw)
        WHERE amount IS NULL OR amount <> 0""",
    "statement_rows": """
        SELECT pos, account_id, CAST(COALESCE(try_strptime(value_date, '%m/%d/%Y'), try_strptime(value_date, '%Y-%m-%d')) AS DATE) AS date, amount,
               payment_details AS description, beneficiary,
               CASE WHEN transaction_type LIKE '%Cash%' THEN 'Cash'
                    WHEN transaction_type LIKE '%Credit%' THEN 'Electronic payment'
                    WHEN transaction_type LIKE '%Debit Card%' THEN 'Debit card'
                    WHEN transaction_type LIKE '%Standing Order%' THEN 'Electronic payment'
                    WHEN transaction_type LIKE '%Direct Debit%' THEN 'Electronic payment'
                    ELSE transaction_type END AS type
        FROM statement_money""",
    "staging": """
        SELECT pos AS tid, account_id, COALESCE(date, DATE '2001-07-15') AS date, COALESCE(amount, 0) AS amount, type,
               CASE WHEN length(description) BETWEEN 1 AND 128 THEN description ELSE '' END AS description,
               CASE WHEN length(beneficiary) BETWEEN 1 AND 128 THEN beneficiary ELSE '' END AS beneficiary
        FROM statement_rows""",
    # Every statement row staged a second time.
    "staged_twice": """
        SELECT * FROM staging
        UNION ALL SELECT * REPLACE (tid + (SELECT MAX(tid) + 1 FROM staging) AS tid) FROM staging""",
    "promoted": """
        SELECT (SELECT MAX(tid) FROM ledger) + 1 + MIN(tid) AS tid, account_id, date, amount, type,
               description, ' ' AS category, ' ' AS subcategory, ' ' AS tag, TRUE AS status,
               'not provided' AS payee
        FROM (SELECT tid, account_id, date, amount, type,
                     CASE WHEN length(description || '  ' || beneficiary) <= 128
                          THEN description || '  ' || beneficiary ELSE 'not provided' END AS description
              FROM staged_twice) s
        WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.account_id = s.account_id AND l.date = s.date
                          AND l.amount = s.amount AND l.type = s.type AND l.description = s.description
                          AND l.category = ' ' AND l.subcategory = ' ')
        GROUP BY account_id, date, amount, type, description""",
}


def _wrapped(name: str) -> str:
    return f"{name} AS ({VIEWS[name]})"


def _used(sql: str, found: list[str]) -> None:
    for name in VIEWS:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql) and name not in found:
            _used(VIEWS[name], found)
            if name not in found:
                found.append(name)


def with_views(sql: str) -> str:
    """The query with the views it uses in front of it."""
    found: list[str] = []
    _used(sql, found)
    if not found:
        return sql.strip()
    return "WITH " + ",\n".join(_wrapped(n) for n in found) + f"\nSELECT * FROM ({sql.strip()}) AS answer"
