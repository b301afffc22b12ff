"""The SQL twin of each registered query, for DuckDB over the same tables."""

from __future__ import annotations

from ledgerloom.catalog.views import with_views
from ledgerloom.operators.taxonomy import C, RULES
from ledgerloom.sources.dimensions import CATEGORIES, FREQUENCIES, SUBCATEGORIES, TYPES

AS_OF = "DATE '2001-07-15'"
ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = with_views(sql)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _names(entries: dict[int, str]) -> str:
    return "(VALUES " + ", ".join(f"({k}, {_text(v)})" for k, v in entries.items()) + ")"


def _name_of(code: str, entries: dict[int, str]) -> str:
    return f"(SELECT n FROM {_names(entries)} d(i, n) WHERE i = {code})"


def _case(code: str, entries: dict[int, str]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN {_text(v)}" for k, v in entries.items()) + " END"


MONEY_ROW = "* REPLACE (CAST(amount AS DOUBLE) AS amount)"
KEY = "account_id, date, amount, type, description, category, subcategory"

# Sources and cleaning ------------------------------------------------------

oracle("ledger_scan", f"SELECT {MONEY_ROW} FROM ledger")
oracle("ingest_json_records", f"SELECT {MONEY_ROW} FROM (SELECT * EXCLUDE (tid) FROM ledger)")
oracle("append_ledger", f"""
    SELECT * EXCLUDE (tid) REPLACE (CAST(amount AS DOUBLE) AS amount), FALSE AS twice, date >= DATE '1998-01-01' AS later
    FROM ledger WHERE date >= DATE '1997-01-01'""")
_PLAIN = "* EXCLUDE (tid) REPLACE (CAST(amount AS DOUBLE) AS amount), FALSE AS twice"
oracle("replace_batch", f"SELECT {_PLAIN} FROM ledger WHERE account_id % 2 <> 0 OR date >= DATE '1997-01-01'")
oracle("delete_store", f"SELECT {_PLAIN} FROM ledger WHERE NOT status OR tag IS DISTINCT FROM 'R'")
oracle("edit_store", """
    SELECT account_id, CASE WHEN status THEN date ELSE CAST(date + 1 AS DATE) END AS date,
        CAST(CASE WHEN status THEN amount ELSE amount * 2 END AS DOUBLE) AS amount, type, description, category,
        CASE WHEN status THEN subcategory ELSE 'edited' END AS subcategory, tag, status OR amount < 0 AS status,
        CASE WHEN NOT status AND amount > 0 THEN 'second' ELSE payee END AS payee, FALSE AS twice
    FROM ledger""")
oracle("promote_store", " UNION ALL ".join(
    f"SELECT account_id, date, CAST(amount AS DOUBLE) AS amount, type, description, FALSE AS twice, '{store}' AS store FROM {rows}"
    for store, rows in (("ledger", "ledger"), ("ledger", "promoted WHERE account_id % 2 = 0"), ("staging", "staged_twice WHERE account_id % 2 <> 0"))))
oracle("statement_to_ledger", f"""
    WITH once AS (
        SELECT DISTINCT account_id, COALESCE(date, {AS_OF}) AS date, COALESCE(amount, 0) AS amount, type,
               CASE WHEN length(description || '  ' || COALESCE(beneficiary, '')) <= 128
                    THEN COALESCE(description, '') || '  ' || COALESCE(beneficiary, '') ELSE '' END AS description
        FROM statement_rows),
    days AS (SELECT account_id, date, COUNT(*) AS n_rows, SUM(amount) AS net FROM once GROUP BY account_id, date)
    SELECT account_id, date, n_rows, CAST(COALESCE(balance, 0) + SUM(net) OVER (PARTITION BY account_id ORDER BY date) AS DOUBLE) AS closing_balance
    FROM days LEFT JOIN accounts USING (account_id)""")
oracle("export_json_records", """
    SELECT tid, '{"tid":' || tid || ',"account_id":' || account_id
        || ',"date":"' || CAST(date AS VARCHAR) || 'T00:00:00.000Z"'
        || ',"amount":' || CAST(amount AS VARCHAR)
        || ',"type":"' || type || '"'
        || ',"description":' || COALESCE('"' || description || '"', 'null')
        || ',"category":' || COALESCE('"' || category || '"', 'null')
        || ',"subcategory":' || COALESCE('"' || subcategory || '"', 'null')
        || ',"tag":' || COALESCE('"' || tag || '"', 'null')
        || ',"status":' || CAST(status AS VARCHAR)
        || ',"payee":' || COALESCE('"' || payee || '"', 'null') || '}' AS record
    FROM ledger""")
oracle("homebank_clean", f"SELECT {MONEY_ROW} FROM homebank_clean")
oracle("split_category", "SELECT pos, category, subcategory FROM homebank_split")


def _rewritten(source: str) -> str:
    """The rules one by one over the distinct pairs of `source`, as CTEs."""
    steps = [f"r0 AS (SELECT DISTINCT category AS c0, subcategory AS s0, category, subcategory FROM {source})"]
    for i, (if_c, if_s, column, value) in enumerate(RULES):
        tests = [f"{n} = {_text(v)}" for n, v in (("category", if_c), ("subcategory", if_s)) if v is not None]
        name = "category" if column == C else "subcategory"
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {' AND '.join(tests)} "
                     f"THEN {_text(value)} ELSE {name} END AS {name}) FROM r{i})")
    return "WITH " + ",\n".join(steps) + f"""
        SELECT x.* REPLACE (r.category AS category, r.subcategory AS subcategory)
        FROM {source} x JOIN r{len(RULES)} r
          ON r.c0 IS NOT DISTINCT FROM x.category AND r.s0 IS NOT DISTINCT FROM x.subcategory"""


oracle("reformat_taxonomy", f"SELECT pos, category, subcategory FROM ({_rewritten('homebank_split')})")
oracle("map_paymode", f"SELECT pos, {_case('type', TYPES)} AS type FROM homebank_clean")

_HOMEBANK = f"""
    SELECT account_id, date, CAST(amount AS DOUBLE) AS amount, type, description, category, subcategory,
           tag, status, payee
    FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY pos) AS n
          FROM (SELECT * REPLACE ({_case('type', TYPES)} AS type) FROM ({_rewritten('homebank_split')})))
    WHERE n = 1"""
oracle("ingest_homebank_csv", _HOMEBANK)
oracle("incremental_ingest", _HOMEBANK)

_TWICE = """(SELECT * RENAME (tid AS pos) FROM ledger
             UNION ALL SELECT * REPLACE (tid + (SELECT MAX(tid) FROM ledger) + 1 AS tid) FROM ledger)"""
oracle("dedup_upload", f"""
    SELECT * EXCLUDE (n) REPLACE (CAST(amount AS DOUBLE) AS amount)
    FROM (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY pos) AS n FROM {_TWICE}) WHERE n = 1""")
oracle("new_rows_only", """
    SELECT u.* REPLACE (CAST(amount AS DOUBLE) AS amount) RENAME (tid AS pos) FROM ledger u
    WHERE NOT EXISTS (SELECT 1 FROM done l WHERE l.account_id = u.account_id AND l.date = u.date
        AND l.amount = u.amount AND l.type IS NOT DISTINCT FROM u.type
        AND l.description IS NOT DISTINCT FROM u.description
        AND l.category IS NOT DISTINCT FROM u.category
        AND l.subcategory IS NOT DISTINCT FROM u.subcategory)""")
oracle("new_rows_columnwise", "SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) RENAME (tid AS pos) FROM ledger u WHERE NOT ("
       + " AND ".join(f"EXISTS (SELECT 1 FROM done l WHERE l.account_id = u.account_id"
                      f" AND l.{c} IS NOT DISTINCT FROM u.{c})"
                      for c in ("date", "amount", "type", "description", "category", "subcategory", "tag", "status", "payee")) + ")")
oracle("statement_amount", "SELECT pos, CAST(amount AS DOUBLE) AS amount FROM statement_money")
oracle("statement_type", """
    SELECT pos, CASE WHEN contains(transaction_type, 'Cash') THEN 'Cash'
        WHEN contains(transaction_type, 'Credit') THEN 'Electronic payment'
        WHEN contains(transaction_type, 'Debit Card') THEN 'Debit card'
        WHEN contains(transaction_type, 'Standing Order') OR contains(transaction_type, 'Direct Debit')
        THEN 'Electronic payment' ELSE transaction_type END AS type
    FROM statement_raw""")
oracle("unreadable_dates", "SELECT pos, value_date FROM statement_raw WHERE value_date LIKE '%.%'")
oracle("staging_left", f"SELECT {MONEY_ROW} FROM staging WHERE account_id % 2 <> 0")
oracle("statement_project", f"SELECT {MONEY_ROW} FROM statement_rows")
oracle("ingest_bank_statement", f"SELECT * EXCLUDE (pos) REPLACE (CAST(amount AS DOUBLE) AS amount) FROM statement_rows")


def _fit(name: str, expr: str | None = None, longest: int = 128, default: str = "not provided") -> str:
    expr = expr or name
    return f"CASE WHEN length({expr}) BETWEEN 1 AND {longest} THEN {expr} ELSE '{default}' END AS {name}"


oracle("normalise_transactions", f"""
    SELECT tid, account_id, CASE WHEN status THEN date ELSE {AS_OF} END AS date,
        CASE WHEN type = '3-MEDIUM' THEN 0.0 ELSE CAST(amount AS DOUBLE) END AS amount,
        CASE WHEN type = '5-LOW' THEN 'not provided' ELSE type END AS type,
        {_fit('description', "CASE WHEN type = '2-HIGH' THEN repeat(description, 20) ELSE description END")},
        {_fit('category')}, {_fit('subcategory')},
        CASE WHEN tag IS NULL OR tag = 'A' THEN 'not provided' ELSE tag END AS tag,
        type <> '1-URGENT' AND status AS status, {_fit('payee')}
    FROM ledger""")
oracle("normalise_staging", f"""
    SELECT pos AS tid, account_id, COALESCE(date, {AS_OF}) AS date, COALESCE(CAST(amount AS DOUBLE), 0.0) AS amount, {_fit('type')},
        {_fit('description', "CASE WHEN type = 'Cash' THEN repeat(description, 20) ELSE description END", default='')},
        CASE WHEN type = 'Cash' THEN '' ELSE COALESCE(beneficiary, '') END AS beneficiary
    FROM statement_rows""")
oracle("normalise_schedules", f"""
    SELECT id, account_id, CASE WHEN frequency = 'Weekly' THEN 'monthly' ELSE frequency END AS frequency,
        interval_n, CASE WHEN category = 'PROMO' THEN 16 ELSE day END AS day, start_date,
        CASE WHEN category = 'ECONOMY' THEN {AS_OF} ELSE end_date END AS end_date,
        category <> 'SMALL' AND active AS active, last_approved,
        CASE WHEN category = 'SMALL' THEN 0.0 ELSE CAST(amount AS DOUBLE) END AS amount,
        description, type, category, subcategory,
        CASE WHEN category = 'MEDIUM' THEN 'Todo' ELSE tag END AS tag, payee
    FROM schedules WHERE category <> 'LARGE'""")
oracle("normalise_budgets", """
    SELECT account_id, subject, CASE WHEN unit = 'MACHINERY' THEN 123.0 ELSE CAST(limit_amount AS DOUBLE) END
        AS limit_amount, CAST(last_month AS DOUBLE) AS last_month, 0.0::DOUBLE AS avg_month,
        CASE WHEN unit = 'BUILDING' THEN 'not provided' ELSE unit END AS unit,
        unit <> 'MACHINERY' AND apply AS apply
    FROM budgets""")
oracle("validate_accounts", """
    SELECT *, concat_ws(',', CASE WHEN NOT length(name) BETWEEN 1 AND 128 THEN 'name' END,
        CASE WHEN TRY_CAST(number AS INTEGER) IS NULL THEN 'number' END,
        CASE WHEN currency IS NULL THEN 'currency' END,
        CASE WHEN TRY_CAST(balance AS DECIMAL(18,2)) IS NULL THEN 'balance' END) AS reject_reason
    FROM (SELECT account_id,
            CASE holder WHEN 'user_0' THEN '' WHEN 'user_1' THEN repeat(name, 10) ELSE name END AS name,
            CASE holder WHEN 'user_2' THEN 'A' ELSE '' END || CAST(number AS VARCHAR) AS number,
            CASE WHEN holder <> 'user_3' THEN currency END AS currency,
            CASE WHEN holder IN ('user_3', 'user_4') THEN 'n/a' ELSE CAST(balance AS VARCHAR) END AS balance
          FROM accounts)""")
oracle("validate_users", r"""
    SELECT *, concat_ws(',',
        CASE WHEN length(username) > 64 OR NOT regexp_matches(username, '^\S+$') THEN 'username' END,
        CASE WHEN email IS NULL OR NOT regexp_matches(email, '^\S+@\S+\.\S+$') THEN 'email' END) AS reject_reason
    FROM (SELECT CASE username WHEN 'user_1' THEN 'user 1' WHEN 'user_2' THEN repeat(username, 20)
                 ELSE username END AS username,
                 CASE WHEN username IN ('user_1', 'user_3') THEN 'nobody'
                      WHEN username = 'user_4' THEN NULL ELSE email END AS email
          FROM users)""")
oracle("duplicate_keys", f"""
    SELECT {KEY.replace('amount', 'CAST(amount AS DOUBLE) AS amount')}, COUNT(*) AS n_rows FROM {_TWICE} t
    WHERE description IS NOT NULL AND category IS NOT NULL AND subcategory IS NOT NULL
    GROUP BY account_id, date, t.amount, type, description, category, subcategory HAVING COUNT(*) > 1""")

# Staging and edits ---------------------------------------------------------

oracle("promote_staging", f"SELECT {MONEY_ROW} FROM promoted")
oracle("promote_report", """
    SELECT account_id, COALESCE(b, 0) AS transactions_before, COALESCE(s, 0) AS to_be_added,
           COALESCE(p, 0) AS added, COALESCE(s, 0) - COALESCE(p, 0) AS duplicates,
           COALESCE(b, 0) + COALESCE(p, 0) AS transactions_after
    FROM (SELECT account_id, COUNT(*) AS b FROM ledger GROUP BY account_id)
    FULL JOIN (SELECT account_id, COUNT(*) AS s FROM staged_twice GROUP BY account_id) USING (account_id)
    LEFT JOIN (SELECT account_id, COUNT(*) AS p FROM promoted GROUP BY account_id) USING (account_id)""")
oracle("apply_edits", """
    SELECT tid, account_id, CASE WHEN status THEN date ELSE CAST(date + 1 AS DATE) END AS date,
        CAST(CASE WHEN status THEN amount ELSE amount * 2 END AS DOUBLE) AS amount, type, description, category,
        CASE WHEN status THEN subcategory ELSE 'edited' END AS subcategory, tag,
        status OR amount < 0 AS status,
        CASE WHEN NOT status AND amount > 0 THEN 'second' ELSE payee END AS payee
    FROM ledger""")
oracle("apply_staging_edits", """
    SELECT * REPLACE (CAST(CASE WHEN type = 'Cash' THEN -amount ELSE amount END AS DOUBLE) AS amount,
                      CASE WHEN type = 'Cash' THEN 'edited' ELSE beneficiary END AS beneficiary) FROM staging""")
oracle("delete_rows", f"SELECT {MONEY_ROW} FROM ledger WHERE tag IS DISTINCT FROM 'R'")
oracle("staging_listing", f"SELECT {MONEY_ROW} FROM staging")
oracle("apply_account_edits", """
    SELECT * REPLACE (CAST(greatest(balance, 0) AS DOUBLE) AS balance), balance < 0 AS changed FROM accounts""")
oracle("apply_status", f"""
    SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount, status OR amount > 0 AS status) FROM ledger""")
oracle("apply_schedule_edits", """
    SELECT * REPLACE (TRUE AS active, CAST(amount AS DOUBLE) AS amount,
        CAST(CASE WHEN active THEN interval_n ELSE interval_n + 1 END AS INTEGER) AS interval_n,
        CASE WHEN active THEN payee ELSE 'edited' END AS payee) FROM schedules""")
oracle("upsert_budgets", """
    SELECT account_id, subject, CASE WHEN apply THEN 5000.0::DOUBLE ELSE CAST(limit_amount AS DOUBLE) END AS limit_amount,
        CAST(last_month AS DOUBLE) AS last_month, CAST(avg_month AS DOUBLE) AS avg_month, unit, FALSE AS apply
    FROM budgets
    UNION ALL SELECT account_id, 'Leisure', 250.0, 0.0, 0.0, currency, TRUE FROM accounts WHERE balance < 0""")

# Filters -------------------------------------------------------------------

oracle("completed_only", f"SELECT {MONEY_ROW} FROM ledger WHERE status")
oracle("open_only", f"SELECT {MONEY_ROW} FROM ledger WHERE NOT status")
oracle("nature_flag", """
    SELECT tid, account_id, date, CAST(amount AS DOUBLE) AS amount,
           CASE WHEN amount > 0 THEN 'income' ELSE 'outgo' END AS nature FROM ledger""")
oracle("nature_outgo", """
    SELECT tid, account_id, date, CAST(amount AS DOUBLE) AS amount FROM ledger WHERE amount <= 0""")
oracle("ledger_filter", f"""
    SELECT {MONEY_ROW} FROM ledger WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
    AND ledger.amount >= -200000 AND regexp_matches(category, '^[ES]') AND regexp_matches(tag, 'A|N')
    AND regexp_matches(description, 'e')""")
oracle("clamped_filter", f"""
    SELECT {MONEY_ROW} FROM ledger l WHERE date >= DATE '2000-01-01'
    OR (SELECT MAX(date) FROM ledger m WHERE m.account_id = l.account_id) <= DATE '2000-01-01'""")
oracle("clamped_filter_both_ends", f"""
    SELECT {MONEY_ROW} FROM ledger l WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'
    AND (l.amount <= -300000
         OR (SELECT MIN(m.amount) FROM ledger m WHERE m.account_id = l.account_id) >= -300000)""")
_TABLE_FILTER = """ledger.amount > -300000 AND ledger.amount < -1000
    AND date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND type = '3-MEDIUM'
    AND contains(lower(category), 'o') AND contains(lower(payee), 'supplier#0000000')
    AND tag IN ('A', 'N') AND status"""
oracle("table_filter", f"SELECT {MONEY_ROW} FROM ledger WHERE {_TABLE_FILTER}")
oracle("filtered_totals", f"""
    SELECT COUNT(*) AS n_rows, COALESCE(CAST(SUM(amount) AS DOUBLE), 0.0) AS total FROM ledger WHERE {_TABLE_FILTER}""")

# Table query ---------------------------------------------------------------

for _name, _test in {
    "tq_contains": "description ILIKE '%IN%'",
    "tq_like": "payee ILIKE 'supplier#%1' AND subcategory LIKE 'Brand#1_'",
    "tq_numeric": "tid >= 5000",
    "tq_range_date": "date BETWEEN DATE '1996-02-01' AND DATE '1998-03-31'",
    "tq_range_date_open": "date <= DATE '1998-03-31'",
    "tq_range_number": "ledger.amount BETWEEN -250000 AND -1000.5",
    "tq_range_number_open": "ledger.amount >= 100000",
    "tq_multi_select": "type IN ('1-URGENT', '5-LOW')",
    "tq_bool": "status",
    "tq_exact": "category = 'PROMO'",
    "tq_column_filters": "category = 'PROMO' AND ledger.amount >= -250000 AND NOT status AND description ILIKE '%ri%'",
    "tq_global_search": " OR ".join(f"CAST(ledger.{c} AS VARCHAR) ILIKE '%brand#1%'" for c in (
        "date", "amount", "type", "category", "description", "payee", "subcategory")),
    "tq_regex_search": " OR ".join(f"regexp_matches(CAST(ledger.{c} AS VARCHAR), 'red w|blue|r[.]g')" for c in (
        "date", "amount", "type", "category", "description", "payee", "subcategory")),
}.items():
    oracle(_name, f"SELECT {MONEY_ROW} FROM ledger WHERE {_test}")
    if _name in ("tq_global_search", "tq_regex_search"):
        oracle(f"{_name}_indexed", f"SELECT {_PLAIN} FROM ledger WHERE {_test}")
oracle("tq_contains_indexed", f"SELECT {_PLAIN} FROM ledger WHERE description ILIKE '%ring%' AND payee ILIKE 'supplier#%1'")

oracle("tq_date", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-03 10:30:00' AND event_type ILIKE '%i%'")
oracle("tq_numeric_events", "SELECT * FROM events WHERE value < 12.5")

_SEARCH = "(" + " OR ".join(f"CAST(ledger.{c} AS VARCHAR) ILIKE '%e%'" for c in (
    "date", "amount", "type", "category", "description", "payee", "subcategory")) + ")"
_TYPE, _CATEGORY, _AMOUNT = "type IN ('1-URGENT', '5-LOW')", "category = 'PROMO'", "ledger.amount >= -250000"
_FACET = f"{_SEARCH} AND {_TYPE} AND {_CATEGORY} AND {_AMOUNT}"
_PAGE = "tid, date, CAST(amount AS DOUBLE) AS amount, type, category, description, payee, subcategory, status"
_ORDER = "ORDER BY ledger.category DESC NULLS LAST, ledger.date ASC NULLS FIRST, ledger.tid"
oracle("tq_sort", f"SELECT {MONEY_ROW} FROM ledger WHERE {_FACET}")
oracle("tq_page", f"SELECT {_PAGE} FROM ledger WHERE {_FACET} {_ORDER} LIMIT 10 OFFSET 20")
oracle("tq_page_deep", f"SELECT {_PAGE} FROM ledger ORDER BY amount DESC, tid LIMIT 200 OFFSET 14000")
oracle("tq_page_index", f"SELECT {_PAGE} FROM ledger ORDER BY amount DESC, tid LIMIT 200 OFFSET 14000")
oracle("tq_page_following", f"""
    SELECT {_PAGE} FROM ledger
    WHERE type > '3-MEDIUM' OR type = '3-MEDIUM' AND (ledger.amount < 1000 OR ledger.amount = 1000 AND tid > 5000)
    ORDER BY type, ledger.amount DESC, tid LIMIT 200""")
oracle("tq_page_rest", f"SELECT {_PAGE} FROM ledger WHERE {_FACET} {_ORDER} OFFSET 20")
oracle("tq_counts", f"""
    SELECT COUNT(*) AS records_total, COUNT(*) FILTER (WHERE {_FACET}) AS records_filtered,
           CAST(1 AS INTEGER) AS draw FROM ledger""")
oracle("tq_facet_range", """
    SELECT 'amount' AS facet, CAST(floor(MIN(amount)) AS BIGINT) AS low, CAST(ceil(MAX(amount)) AS BIGINT) AS high
    FROM ledger""")
oracle("tq_facet_values", f"""
    SELECT DISTINCT 'type' AS facet, type AS value FROM ledger WHERE {_SEARCH} AND {_CATEGORY} AND {_AMOUNT}
    UNION ALL
    SELECT DISTINCT 'category', category FROM ledger WHERE {_SEARCH} AND {_TYPE} AND {_AMOUNT}""")

# Lookups -------------------------------------------------------------------

oracle("user_accounts", """
    SELECT u.*, (SELECT COUNT(*) FROM accounts a WHERE a.holder = u.username) AS account_count FROM users u""")
oracle("held_accounts", """
    SELECT holder, account_id, name, number, currency, CAST(balance AS DOUBLE) AS balance
    FROM accounts JOIN users ON holder = username""")
oracle("holder_transactions", """
    SELECT l.* REPLACE (CAST(amount AS DOUBLE) AS amount), username
    FROM ledger l JOIN accounts a ON a.account_id = l.account_id JOIN users ON holder = username""")
oracle("dimension_lists", " UNION ALL ".join(
    f"SELECT DISTINCT '{k}' AS kind, {k} AS name FROM ledger WHERE {k} IS NOT NULL"
    for k in ("type", "category", "subcategory")))
oracle("resolve_dimension_ids", f"""
    SELECT account_id, tid, date, CAST(amount AS DOUBLE) AS amount, description,
        {_case('tid % 11', TYPES)} AS type, {_case('1 + tid % 22', CATEGORIES)} AS category,
        {_case('1 + tid % 48', SUBCATEGORIES)} AS subcategory, {_case('1 + tid % 5', FREQUENCIES)} AS frequency
    FROM ledger""")
oracle("effective_categories", f"""
    SELECT account_id, subject FROM budgets
    UNION ALL SELECT account_id, n FROM accounts, {_names(CATEGORIES)} d(i, n)
    WHERE account_id NOT IN (SELECT account_id FROM budgets)""")
for _name, _entries, _view in (("seed_budgets", CATEGORIES, "budgets"),
                               ("seed_budgets_subcategory", SUBCATEGORIES, "subbudgets")):
    oracle(_name, f"""
        SELECT account_id, n AS subject, 100.0::DOUBLE AS limit_amount, 0.0::DOUBLE AS last_month,
               0.0::DOUBLE AS avg_month, currency AS unit, FALSE AS apply
        FROM accounts, {_names(_entries)} d(i, n)
        WHERE account_id NOT IN (SELECT account_id FROM {_view})""")
_BUDGET = ("account_id, subject, CAST(limit_amount AS DOUBLE) AS limit_amount, "
           "CAST(last_month AS DOUBLE) AS last_month, CAST(avg_month AS DOUBLE) AS avg_month, unit, apply")
oracle("budget_listing", f"""
    SELECT {_BUDGET}, 'category' AS kind FROM budgets
    UNION ALL SELECT {_BUDGET}, 'subcategory' FROM subbudgets""")

# Balances ------------------------------------------------------------------

_OVERVIEW = """
    SELECT a.account_id, name AS account_name, CAST(balance AS DOUBLE) AS opening_balance,
        COUNT(tid) AS total_transactions, COUNT(tid) - COUNT(tid) FILTER (WHERE status) AS pending_transactions,
        CAST(balance + COALESCE(SUM(amount) FILTER (WHERE status), 0) AS DOUBLE) AS closing_balance,
        currency AS account_currency
    FROM accounts a LEFT JOIN ledger l ON l.account_id = a.account_id
    GROUP BY a.account_id, name, balance, currency"""
oracle("account_overview", _OVERVIEW)
oracle("portfolio_total", """
    SELECT CAST((SELECT SUM(balance) FROM accounts) + (SELECT SUM(amount) FROM done) AS DOUBLE) AS closing_total,
           CAST((SELECT SUM(amount) FROM ledger) AS DOUBLE) AS ledger_total""")


def _running(source: str, way: str = "") -> str:
    return f"""SELECT l.*, a.balance + SUM(amount) OVER (PARTITION BY l.account_id
        ORDER BY date {way}, tid {way} ROWS UNBOUNDED PRECEDING) AS closing
        FROM {source} l JOIN accounts a ON a.account_id = l.account_id"""


oracle("running_balance", f"""
    SELECT tid, account_id, date, CAST(amount AS DOUBLE) AS amount, CAST(closing AS DOUBLE) AS closing_balance
    FROM ({_running('done')})""")
oracle("ledger_log", f"""
    SELECT * EXCLUDE (closing) REPLACE (CAST(amount AS DOUBLE) AS amount, trim(tag) AS tag),
           CAST(closing AS DOUBLE) AS closing_balance FROM ({_running('ledger', 'DESC')})""")

# A row alone on its date has its place whatever its id.
oracle("running_balance_unnumbered", f"""
    SELECT CASE WHEN COUNT(*) OVER (PARTITION BY account_id, date) > 1 THEN tid END AS tid, account_id, date,
           CAST(amount AS DOUBLE) AS amount, CAST(closing AS DOUBLE) AS closing_balance
    FROM ({_running('done')})""")

_LAST = "(SELECT MAX(date) FROM {source} m WHERE m.account_id = {row}.account_id)"


def _closing(period: str, name: str, months: int | None = None, outgo: bool = False) -> str:
    """Last running balance of each period."""
    kept = f"(SELECT * FROM ({_running('done')}) WHERE {'amount <= 0' if outgo else 'TRUE'})"
    span = "TRUE" if months is None else (
        f"date >= date_trunc('month', MAX(date) OVER (PARTITION BY account_id)) - INTERVAL {months - 1} MONTH")
    return f"""
        SELECT account_id, {name}, CAST(closing AS DOUBLE) AS closing_balance
        FROM (SELECT account_id, {period} AS {name}, closing, row_number() OVER (
                  PARTITION BY account_id, {period} ORDER BY date DESC, tid DESC) AS n
              FROM (SELECT *, {span} AS inside FROM {kept}) WHERE inside) WHERE n = 1"""


oracle("closing_balance_year", _closing("CAST(year(date) AS INTEGER)", "year"))
for _span, _months in (("month", None), ("l12m", 12), ("l3m", 3)):
    oracle(f"closing_balance_{_span}", _closing("strftime(date, '%Y-%m')", "yearmonth", _months))
    oracle(f"closing_balance_{_span}_outgo", _closing("strftime(date, '%Y-%m')", "yearmonth", _months, True))
for _months in (3, 12, 24):
    oracle(f"trailing_months_{_months}", f"""
        SELECT tid, account_id, date, CAST(amount AS DOUBLE) AS amount FROM done d
        WHERE date >= date_trunc('month', {_LAST.format(source='done', row='d')}) - INTERVAL {_months - 1} MONTH""")
oracle("latest_transactions", f"""
    SELECT {MONEY_ROW} FROM ledger l WHERE date > CASE
        WHEN {_LAST.format(source='ledger', row='l')} > {AS_OF} - 30 THEN {AS_OF} - 30
        ELSE {_LAST.format(source='ledger', row='l')} - 7 END""")

# Sums by period ------------------------------------------------------------

SPANS = {"year": ("CAST(year(date) AS INTEGER)", None), "month": ("strftime(date, '%Y-%m')", None),
         "l12m": ("strftime(date, '%Y-%m')", 12), "l3m": ("strftime(date, '%Y-%m')", 3)}


def _cells(subject: str, span: str, outgo: bool = False) -> str:
    period, months = SPANS[span]
    col = "trim(tag)" if subject == "tag" else subject
    source = "(SELECT * FROM done WHERE amount <= 0)" if outgo else "done"
    inside = "TRUE" if months is None else (
        f"date >= date_trunc('month', MAX(date) OVER (PARTITION BY account_id)) - INTERVAL {months - 1} MONTH")
    return f"""SELECT account_id, {period} AS period, {col} AS subject, SUM(amount) AS net
        FROM (SELECT *, {inside} AS inside FROM {source}) WHERE inside AND {col} IS NOT NULL
        GROUP BY 1, 2, 3"""


def _pivot(subject: str, values: list[str], span: str, outgo: bool) -> str:
    cols = ", ".join(
        f"CAST(COALESCE(SUM(net) FILTER (WHERE subject = '{v}'), 0) AS DOUBLE) AS \"{v}\"" for v in values)
    return f"SELECT account_id, period, {cols} FROM ({_cells(subject, span, outgo)}) GROUP BY account_id, period"


def _percent(subject: str, span: str) -> str:
    """Cents as integers: rounded half up without fractions."""
    return f"""
        SELECT account_id, period, subject, income_cents / 100.0::DOUBLE AS income,
            CASE WHEN cents < 0 AND income_cents > 0
                 THEN CAST((-cents * 20000 + income_cents) // (2 * income_cents) AS DOUBLE) / 100.0::DOUBLE
                 ELSE 0.0::DOUBLE END AS percent
        FROM (SELECT *, CAST(SUM(greatest(cents, 0)) OVER (PARTITION BY account_id, period) AS HUGEINT) AS income_cents
              FROM (SELECT account_id, period, subject, CAST(net * 100 AS HUGEINT) AS cents
                    FROM ({_cells(subject, span)})))
        WHERE subject <> 'not provided'"""


_PIVOT_VALUES = {
    "tag": ["A", "N", "R"],
    "category": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    "subcategory": [f"Brand#{i}" for i in range(1, 26)],
}
for _subject, _values in _PIVOT_VALUES.items():
    for _span in SPANS:
        for _suffix, _outgo in (("", False), ("_outgo", True)):
            oracle(f"spend_by_period_{_subject}_{_span}{_suffix}",
                   f"SELECT * REPLACE (CAST(net AS DOUBLE) AS net) FROM ({_cells(_subject, _span, _outgo)})")
    for _span in SPANS:
        _end = "" if _span == "year" else f"_{_span}"
        oracle(f"pivot_{_subject}{_end}", _pivot(_subject, _values, _span, False))
        oracle(f"pivot_{_subject}{_end}_outgo", _pivot(_subject, _values, _span, True))
        oracle(f"percent_of_income_{_subject}{_end}", _percent(_subject, _span))
    oracle("spend_share" if _subject == "category" else f"spend_share_{_subject}", f"""
        SELECT account_id, subject, CAST(SUM(CASE WHEN net < 0 THEN -net ELSE 0 END) AS DOUBLE) AS spent
        FROM ({_cells(_subject, 'month')}) GROUP BY account_id, subject""")

oracle("pivot_tag_wide", """
    SELECT account_id, period, COUNT(*) AS n_subjects, CAST(SUM(net) AS DOUBLE) AS net
    FROM (SELECT account_id, year(date) AS period, trim(payee) AS subject, SUM(amount) AS net FROM done WHERE payee IS NOT NULL GROUP BY ALL)
    WHERE net <> 0 GROUP BY account_id, period""")

# Budgets -------------------------------------------------------------------

_INCOME = """
    SELECT account_id, CAST(SUM(income) AS DOUBLE) / NULLIF(COUNT(income), 0) AS average_income
    FROM (SELECT account_id, date_trunc('month', date) AS ym,
                 SUM(amount) FILTER (WHERE amount > 0 AND tag IS DISTINCT FROM 'Superfuture') AS income
          FROM (SELECT *, MAX(date) OVER (PARTITION BY account_id) AS last_date FROM done)
          WHERE date >= date_trunc('month', last_date) - INTERVAL 23 MONTH
          GROUP BY account_id, ym)
    GROUP BY account_id"""
oracle("average_monthly_income", _INCOME)


def _subject_months(subject: str, months: int) -> str:
    return f"""SELECT account_id, {subject} AS subject, date_trunc('month', date) AS ym, SUM(amount) AS net,
        ANY_VALUE(last_date) AS last_date
        FROM (SELECT *, MAX(date) OVER (PARTITION BY account_id) AS last_date FROM done)
        WHERE date >= date_trunc('month', last_date) - INTERVAL {months - 1} MONTH AND {subject} IS NOT NULL
        GROUP BY account_id, {subject}, ym"""


for _subject in ("category", "subcategory"):
    oracle(f"last_month_{_subject}", f"""
        SELECT account_id, subject, CAST(net AS DOUBLE) AS last_month FROM ({_subject_months(_subject, 1)})""")
    oracle(f"avg_month_{_subject}", f"""
        SELECT account_id, subject, CAST(SUM(net) AS DOUBLE) / COUNT(*) AS avg_month
        FROM ({_subject_months(_subject, 12)}) GROUP BY account_id, subject""")
for _name, _subject, _view in (("refresh_budgets", "category", "budgets"),
                               ("refresh_budgets_subcategory", "subcategory", "subbudgets")):
    oracle(_name, f"""
    SELECT b.account_id, b.subject, CAST(b.limit_amount AS DOUBLE) AS limit_amount,
        CAST(COALESCE(n.last_month, b.last_month) AS DOUBLE) AS last_month,
        COALESCE(n.avg_month, CAST(b.avg_month AS DOUBLE)) AS avg_month, b.unit, b.apply
    FROM {_view} b LEFT JOIN (
        SELECT account_id, subject, SUM(net) FILTER (WHERE ym = date_trunc('month', last_date)) AS last_month,
               CAST(SUM(net) AS DOUBLE) / COUNT(*) AS avg_month
        FROM ({_subject_months(_subject, 12)}) GROUP BY account_id, subject) n
    ON n.account_id = b.account_id AND n.subject = b.subject""")


def _ratio(part: str, whole: str) -> str:
    return (f"CASE WHEN CAST({whole} AS DOUBLE) > 0 THEN CAST({part} AS DOUBLE) * 100.0::DOUBLE "
            f"/ CAST({whole} AS DOUBLE) ELSE 0.0::DOUBLE END")


def _budget_pct(subject: str) -> str:
    return (f"CASE WHEN {subject}_b.apply THEN {_ratio(f'{subject}_spend', f'{subject}_b.limit_amount')} "
            f"WHEN NOT {subject}_b.apply THEN {_ratio(f'{subject}_spend', 'average_income')} "
            f"ELSE 0.0::DOUBLE END AS {subject}_pct")


_SPENDS = ", ".join(f"abs(COALESCE(SUM(amount) FILTER (WHERE {s} = {s}_now), 0)) AS {s}_spend"
                    for s in ("tag", "category", "subcategory"))
oracle("budget_gauge", f"""
    WITH monthly AS (
        SELECT *, strftime(date, '%Y-%m') AS ym, strftime({AS_OF}, '%Y-%m') AS now_ym FROM done),
    chosen AS (
        SELECT account_id, COALESCE(MAX(ym) FILTER (WHERE ym = now_ym), MAX(ym)) AS ym
        FROM monthly GROUP BY account_id),
    current_rows AS (SELECT m.* FROM monthly m JOIN chosen c ON c.account_id = m.account_id AND c.ym = m.ym),
    shown AS (
        SELECT account_id, ym, tag AS tag_now, category AS category_now, subcategory AS subcategory_now
        FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY date DESC, tid) AS n
              FROM current_rows) WHERE n = 1),
    spends AS (
        SELECT account_id, abs(COALESCE(SUM(amount) FILTER (WHERE amount < 0), 0)) AS spent, {_SPENDS}
        FROM current_rows JOIN shown USING (account_id) GROUP BY account_id),
    income AS ({_INCOME})
    SELECT a.account_id, s.ym AS period,
        CASE WHEN s.ym IS NULL THEN '' ELSE tag_now END AS tag,
        CASE WHEN s.ym IS NULL THEN '' ELSE category_now END AS category,
        CASE WHEN s.ym IS NULL THEN '' ELSE subcategory_now END AS subcategory,
        {_ratio('spent', 'average_income')} AS expense_spent_pct,
        {_ratio('tag_spend', 'average_income')} AS tag_pct,
        {_budget_pct('category')}, {_budget_pct('subcategory')},
        CAST(75 AS INTEGER) AS expense_budget, CAST(100 AS INTEGER) AS subject_budget, CAST(100 AS INTEGER) AS total
    FROM accounts a LEFT JOIN shown s ON s.account_id = a.account_id
    LEFT JOIN spends p ON p.account_id = a.account_id LEFT JOIN income i ON i.account_id = a.account_id
    LEFT JOIN budgets category_b ON category_b.account_id = a.account_id AND category_b.subject = category_now
    LEFT JOIN subbudgets subcategory_b
      ON subcategory_b.account_id = a.account_id AND subcategory_b.subject = subcategory_now""")

# Schedules -----------------------------------------------------------------

for _frequency in ("Monthly", "Weekly", "Yearly"):
    oracle(f"next_due_{_frequency.lower()}", f"""
        SELECT id, interval_n, day, start_date, end_date, due
        FROM schedules LEFT JOIN due USING (id) WHERE frequency = '{_frequency}'""")


def _due(frequency: str, interval: str, day: str, start: str, end: str, fits: str) -> str:
    """Every day of every rule is tried."""
    return f"""
        WITH rules AS (SELECT id, '{frequency}' AS frequency, CAST({interval} AS INTEGER) AS interval_n, CAST({day} AS INTEGER) AS day,
                              CAST({start} AS DATE) AS start_date, CAST({end} AS DATE) AS end_date FROM schedules),
        days AS (SELECT *, CAST(UNNEST(generate_series(start_date, COALESCE(end_date, start_date + INTERVAL 500 YEAR), INTERVAL 1 {"MONTH" if frequency == "Yearly" else "DAY"})) AS DATE) AS c FROM rules),
        found AS (SELECT id, MIN({"date_trunc('month', c) + (day - 1) * INTERVAL 1 DAY" if frequency == "Yearly" else "c"}) AS due FROM days WHERE {fits} GROUP BY id)
        SELECT id, frequency, interval_n, day, start_date, end_date, CAST(due AS DATE) AS due FROM rules LEFT JOIN found USING (id)"""


_MONTHS = "((year(c) - year(start_date)) * 12 + month(c) - month(start_date))"
oracle("next_due_quarterly", _due("Quarterly", "interval_n", "day", "start_date", "start_date + INTERVAL 60 MONTH",
                                  f"{_MONTHS} % (3 * interval_n) = 0 AND day(c) = day"))
oracle("next_due_from_month_end", _due("Monthly", "interval_n", "-(day % 5)", "start_date", "NULL", f"""
    c < start_date + INTERVAL 8 MONTH AND ((day = 0 AND c = start_date)
    OR ({_MONTHS} % interval_n = 0 AND day(c) = day(last_day(c)) + 1 + day AND day < 0))""").replace("INTERVAL 500 YEAR", "INTERVAL 8 MONTH"))
# Months that begin after the 15th of the first month; all days of those of the first year, else of January.
oracle("next_due_long_interval", _due("Yearly", "240", "day", "DATE '1850-12-15' - CAST(id % 12 AS INTEGER) * INTERVAL 1 MONTH", "NULL", """
    (year(c) - year(start_date)) % 240 = 0 AND day <= day(last_day(c)) AND date_trunc('month', c) + (day - 1) * INTERVAL 1 DAY >= start_date
    AND c < DATE '2101-01-01'"""))
oracle("upcoming_transactions", f"SELECT {MONEY_ROW} FROM upcoming")
oracle("post_due", """
    SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount, TRUE AS status)
    FROM upcoming WHERE stid IN (SELECT stid FROM decisions WHERE approve)""")
oracle("advance_schedules", f"""
    SELECT s.* REPLACE (CAST(s.amount AS DOUBLE) AS amount,
        CASE WHEN approve THEN {AS_OF} ELSE last_approved END AS last_approved,
        CASE WHEN approve THEN CAST(due + 1 AS DATE) ELSE start_date END AS start_date)
    FROM schedules s LEFT JOIN decisions d ON d.stid = s.id LEFT JOIN due USING (id)""")
oracle("reschedule", """
    SELECT s.* REPLACE (CAST(s.amount AS DOUBLE) AS amount,
        CASE WHEN NOT approve THEN d.date ELSE start_date END AS start_date)
    FROM schedules s LEFT JOIN decisions d ON d.stid = s.id""")
oracle("schedule_listing", """
    SELECT id, account_id, frequency, interval_n, day, start_date, end_date, last_approved AS approved,
           CAST(amount AS DOUBLE) AS amount, category, subcategory, payee, description, active
    FROM schedules""")

# Stored state --------------------------------------------------------------

# What the stores end with is what the operators make of the whole tables.
for _name, _same in (("account_overview_kept", "account_overview"), ("refresh_budgets_kept", "refresh_budgets"),
                     ("closing_balance_month_kept", "closing_balance_month"), ("percent_of_income_category_kept", "percent_of_income_category"),
                     ("average_monthly_income_kept", "average_monthly_income"), ("budget_store", "upsert_budgets")):
    oracle(_name, f"SELECT * FROM ({ORACLE[_same]})")
oracle("running_balance_since", f"""
    SELECT account_id, date, COUNT(*) AS n_rows, CAST(max_by(closing, tid) AS DOUBLE) AS closing_balance
    FROM ({_running('done')}) WHERE date >= DATE '1997-05-17' GROUP BY account_id, date""")
oracle("post_due_store", """
    SELECT * EXCLUDE (stid) REPLACE (CAST(amount AS DOUBLE) AS amount, TRUE AS status), FALSE AS twice
    FROM upcoming WHERE stid IN (SELECT stid FROM decisions WHERE approve)""")
oracle("schedule_store", f"""
    SELECT s.id, s.account_id, frequency, CASE WHEN active THEN interval_n ELSE CAST(interval_n + 1 AS INTEGER) END AS interval_n, day,
           CASE WHEN approve THEN CAST(due + 1 AS DATE) WHEN NOT approve THEN d.date ELSE start_date END AS start_date, end_date,
           CASE WHEN approve THEN {AS_OF} ELSE last_approved END AS approved, CAST(amount AS DOUBLE) AS amount, category, subcategory,
           CASE WHEN active THEN payee ELSE 'edited' END AS payee, description, TRUE AS active
    FROM schedules s LEFT JOIN decisions d ON d.stid = s.id LEFT JOIN due USING (id)""")
