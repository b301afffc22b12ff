"""The registered queries: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal
from functools import partial, wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.catalog import inputs
from ledgerloom.functions.money import edge
from ledgerloom.operators import (
    balances, budgets, cleaning, dedup, edits, filters, lookups, normalise, promote,
    schedules, shares, taxonomy, validation,
)
from ledgerloom.operators.table_query import TableColumn, TableQuery, TableRequest
from ledgerloom.plans.skew import key_counts
from ledgerloom.plans.workspace import run_folder, stored
from ledgerloom.schema import MONEY, STAGING, SUBJECTS
from ledgerloom.sources import kept, keyed, page_index, promotion, star, stores, text_index, uploads
from ledgerloom.sources.dimensions import CATEGORIES, SUBCATEGORIES
from ledgerloom.streaming.incremental import ingest_new_files, stored_rows

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.date(2001, 7, 15)
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    """Registers a query; its decimals leave as doubles."""
    def register(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return edge(f(spark, folder))

        QUERIES[name] = run
        return f

    return register


def _done(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Completed rows with the columns asked for."""
    return filters.completed(star.ledger(spark, folder, *{*columns, "status"})).select(*columns)


# What balances need of a row.
MOVES = ("tid", "account_id", "date", "amount")

# Sources and sinks ---------------------------------------------------------

@query("ledger_scan")
def ledger_scan(spark, folder):
    return star.ledger(spark, folder)


@query("ingest_json_records")
def ingest_json_records(spark, folder):
    raw = uploads.read_json_records(
        spark, inputs.json_files(spark, folder), pattern="*.txt",
        schema=uploads.JSON_SCHEMA + ", account_id long")
    return dedup.first_of_each(cleaning.json_rows(raw).drop("file")).drop("pos")


@query("ingest_homebank_csv")
def ingest_homebank_csv(spark, folder):
    raw = uploads.read_homebank(spark, inputs.homebank_files(spark, folder))
    rows = raw.withColumn("account_id", F.col("info").cast("long")).drop("file")
    return cleaning.homebank_rows(rows).drop("pos")


@query("ingest_bank_statement")
def ingest_bank_statement(spark, folder):
    raw = uploads.read_statement(
        spark, inputs.statement_files(spark, folder), pattern="*.txt",
        others={"Customer Reference": "reference"})
    rows = raw.withColumn("account_id", F.col("reference").cast("long")).drop("file")
    return cleaning.statement_rows(rows).drop("pos")


@query("export_json_records")
def export_json_records(spark, folder):
    return stores.json_records(star.ledger(spark, folder))


# Cleaning ------------------------------------------------------------------

@query("append_ledger")
def append_ledger(spark, folder):
    """The older and the newer half are appended one after the other; ids follow the order of appends."""
    path, rows = run_folder(spark, "appended"), star.ledger(spark, folder)
    split = F.lit(dt.date(1998, 1, 1))
    for half in (rows.where(F.col("date") < split), rows.where(F.col("date") >= split)):
        stores.append_rows(half, path)
    late = stores.read_ledger(spark, path, first=dt.date(1997, 1, 1))
    order = F.count(F.lit(1)).over(Window.partitionBy("tid"))
    return late.withColumns({"twice": order > 1, "later": F.col("tid") >= rows.where(F.col("date") < split).count()}).drop("tid")


def _unique(rows):
    """The rows with a flag for ids that are there twice, instead of the ids."""
    return rows.withColumn("twice", F.count(F.lit(1)).over(Window.partitionBy("tid")) > 1).drop("tid")


@query("replace_batch")
def replace_batch(spark, folder):
    """Two batches of all years; the second comes again with its later years alone."""
    path, rows = run_folder(spark, "replaced"), star.ledger(spark, folder)
    even, late = F.col("account_id") % 2 == 0, F.col("date") >= F.lit(dt.date(1997, 1, 1))
    for name, part in (("odd", ~even), ("even", even), ("even", even & late)):
        stores.append_rows(rows.where(part), path, name)
    return _unique(stores.read_ledger(spark, path))


@query("edit_store")
def edit_store(spark, folder):
    """Edits of stored rows, written back and read again."""
    path = run_folder(spark, "edited")
    stores.append_rows(star.ledger(spark, folder), path)
    stores.edit_ledger(spark, path, inputs.edits_of(stores.read_ledger(spark, path)))
    return _unique(stores.read_ledger(spark, path))


@query("delete_store")
def delete_store(spark, folder):
    """Stored rows deleted, and what was appended afterwards has new ids."""
    path, rows = run_folder(spark, "deleted"), star.ledger(spark, folder)
    stores.append_rows(rows.where("status"), path)
    stores.remove_rows(spark, path, stores.read_ledger(spark, path).where(F.col("tag") == "R"))
    stores.append_rows(rows.where(~F.col("status")), path)
    return _unique(stores.read_ledger(spark, path))


@query("promote_store")
def promote_store(spark, folder):
    """Staged rows of the accounts with an even id move to the ledger; the run is repeated and changes nothing."""
    staged, ledger = run_folder(spark, "staged"), run_folder(spark, "ledger")
    stores.append_rows(inputs.staged_twice(spark, folder, AS_OF), staged, schema=STAGING)
    stores.append_rows(star.ledger(spark, folder), ledger)
    some = star.accounts(spark, folder).where(F.col("account_id") % 2 == 0)
    for _ in range(2):
        promotion.promote_store(spark, staged, ledger, AS_OF, "even", some)
    columns = ["tid", "account_id", "date", "amount", "type", "description"]
    moved, left = stores.read_ledger(spark, ledger).select(*columns), stores.read_staging(spark, staged).select(*columns)
    return _unique(moved).withColumn("store", F.lit("ledger")).unionByName(_unique(left).withColumn("store", F.lit("staging")))


@query("statement_to_ledger")
def statement_to_ledger(spark, folder):
    """Statements are read, staged, promoted into an empty ledger and listed with their balances."""
    staged, ledger = run_folder(spark, "staged"), run_folder(spark, "promoted")
    stores.append_rows(cleaning.statement_rows(star.statement_raw(spark, folder)), staged, schema=STAGING)
    rows = stores.read_staging(spark, staged).withColumn("amount", F.coalesce("amount", F.lit(0).cast(MONEY)))
    known = stores.ledger_rows(stores.open_store(spark, ledger, missing_ok=True))
    stores.append_rows(promote.promote_staging(rows, known, AS_OF), ledger)
    listed = balances.running_balance(stores.read_ledger(spark, ledger), star.openings(spark, folder))
    # The balance at the end of each day does not depend on the ids.
    return (listed.groupBy("account_id", "date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max_by("closing_balance", "tid").alias("closing_balance")))


@query("homebank_clean")
def homebank_clean(spark, folder):
    return cleaning.clean_homebank(star.homebank_raw(spark, folder))


@query("split_category")
def split_category(spark, folder):
    rows = cleaning.split_category(cleaning.clean_homebank(star.homebank_raw(spark, folder)))
    return rows.select("pos", "category", "subcategory")


@query("reformat_taxonomy")
def reformat_taxonomy(spark, folder):
    rows = cleaning.split_category(cleaning.clean_homebank(star.homebank_raw(spark, folder)))
    return taxonomy.reformat_taxonomy(rows).select("pos", "category", "subcategory")


@query("map_paymode")
def map_paymode(spark, folder):
    return cleaning.map_paymode(
        cleaning.clean_homebank(star.homebank_raw(spark, folder))).select("pos", "type")


def _uploaded_twice(spark, folder):
    """The whole ledger as one upload, with a second copy of every row after it."""
    rows = star.ledger(spark, folder).withColumnRenamed("tid", "pos")
    greatest = star.ledger(spark, folder, "tid").agg(F.max("tid")).scalar()
    return rows.unionByName(rows.withColumn("pos", F.col("pos") + greatest + 1))


@query("dedup_upload")
def dedup_upload(spark, folder):
    return dedup.first_of_each(_uploaded_twice(spark, folder))


@query("new_rows_only")
def new_rows_only(spark, folder):
    rows = star.ledger(spark, folder)
    return dedup.new_rows(rows.withColumnRenamed("tid", "pos"), filters.completed(rows))


@query("new_rows_columnwise")
def new_rows_columnwise(spark, folder):
    rows = stored(star.ledger(spark, folder), "rows")  # read once for each column
    return dedup.new_rows_columnwise(
        rows.withColumnRenamed("tid", "pos"), filters.completed(rows),
        ["date", "amount", "type", "description", "category", "subcategory", "tag", "status", "payee"])


@query("statement_amount")
def statement_amount(spark, folder):
    return cleaning.statement_amount(star.statement_raw(spark, folder)).select("pos", "amount")


@query("statement_type")
def statement_type(spark, folder):
    return star.statement_raw(spark, folder).select(
        "pos", cleaning.statement_type(F.col("transaction_type")).alias("type"))


@query("statement_project")
def statement_project(spark, folder):
    return cleaning.statement_rows(star.statement_raw(spark, folder))


@query("unreadable_dates")
def unreadable_dates(spark, folder):
    return cleaning.unreadable_dates(star.statement_raw(spark, folder), "value_date", cleaning.statement_date).select("pos", "value_date")


@query("normalise_transactions")
def normalise_transactions(spark, folder):
    return normalise.normalise_transactions(inputs.dirty_ledger(spark, folder), AS_OF)


@query("normalise_staging")
def normalise_staging(spark, folder):
    return normalise.normalise_staging(inputs.dirty_staging(spark, folder), AS_OF)


@query("normalise_schedules")
def normalise_schedules(spark, folder):
    return normalise.normalise_schedules(inputs.dirty_schedules(spark, folder), AS_OF)


@query("normalise_budgets")
def normalise_budgets(spark, folder):
    return normalise.normalise_budgets(inputs.dirty_budgets(spark, folder))


@query("validate_accounts")
def validate_accounts(spark, folder):
    return validation.validate_accounts(inputs.raw_accounts(spark, folder))


@query("validate_users")
def validate_users(spark, folder):
    return validation.validate_users(inputs.raw_users(spark, folder))


@query("duplicate_keys")
def duplicate_keys(spark, folder):
    return validation.duplicate_keys(_uploaded_twice(spark, folder))


# Staging and edits ---------------------------------------------------------

@query("promote_staging")
def promote_staging(spark, folder):
    return promote.promote_staging(
        inputs.staged_twice(spark, folder, AS_OF), star.ledger(spark, folder), AS_OF)


@query("promote_report")
def promote_report(spark, folder):
    return promote.promote_report(
        inputs.staged_twice(spark, folder, AS_OF), star.ledger(spark, folder), AS_OF)


@query("apply_edits")
def apply_edits(spark, folder):
    return edits.apply_edits(star.ledger(spark, folder), inputs.ledger_edits(spark, folder))


@query("apply_staging_edits")
def apply_staging_edits(spark, folder):
    return edits.apply_staging_edits(
        inputs.staging(spark, folder, AS_OF), inputs.staging_edits(spark, folder, AS_OF))


@query("delete_rows")
def delete_rows(spark, folder):
    gone = star.ledger(spark, folder, "tid", "tag").where(F.col("tag") == "R")
    return edits.delete_rows(star.ledger(spark, folder), gone)


@query("staging_left")
def staging_left(spark, folder):
    """The accounts with an even id are promoted."""
    return promote.staging_left(
        inputs.staging(spark, folder, AS_OF), star.accounts(spark, folder).where(F.col("account_id") % 2 == 0))


@query("staging_listing")
def staging_listing(spark, folder):
    return promote.staging_listing(inputs.staging(spark, folder, AS_OF))


@query("apply_account_edits")
def apply_account_edits(spark, folder):
    return edits.apply_account_edits(star.accounts(spark, folder), inputs.account_edits(spark, folder))


@query("apply_status")
def apply_status(spark, folder):
    rows = star.ledger(spark, folder)
    given = filters.still_open(star.ledger(spark, folder, "tid", "amount", "status")).select(
        "tid", (F.col("amount") > 0).alias("status"))
    return edits.apply_status(rows, given)


@query("apply_schedule_edits")
def apply_schedule_edits(spark, folder):
    return edits.apply_schedule_edits(
        star.schedules(spark, folder), inputs.schedule_edits(spark, folder))


@query("upsert_budgets")
def upsert_budgets(spark, folder):
    return budgets.upsert_budgets(star.budgets(spark, folder), inputs.budget_edits(spark, folder))


# Filters -------------------------------------------------------------------

@query("completed_only")
def completed_only(spark, folder):
    return filters.completed(star.ledger(spark, folder))


@query("open_only")
def open_only(spark, folder):
    return filters.still_open(star.ledger(spark, folder))


@query("nature_flag")
def nature_flag(spark, folder):
    return filters.with_nature(star.ledger(spark, folder, "tid", "account_id", "date", "amount"))


@query("nature_outgo")
def nature_outgo(spark, folder):
    return filters.outgo(star.ledger(spark, folder, "tid", "account_id", "date", "amount"))


@query("ledger_filter")
def ledger_filter(spark, folder):
    return filters.ledger_filter(star.ledger(spark, folder), filters.LedgerFilter(
        date_from=dt.date(1996, 1, 1), date_to=dt.date(2000, 12, 31), amount_ge=Decimal("-200000"),
        category_like="^[ES]", tag_like="A|N", description_like="e"))


@query("clamped_filter")
def clamped_filter(spark, folder):
    return filters.clamped_filter(
        star.ledger(spark, folder), AS_OF, date_from=dt.date(2000, 1, 1),
        amount_ge=Decimal(500), amount_le=Decimal(100), moves=star.ledger(spark, folder, *MOVES))


@query("clamped_filter_both_ends")
def clamped_filter_both_ends(spark, folder):
    return filters.clamped_filter(
        star.ledger(spark, folder), AS_OF, date_from=dt.date(1998, 1, 1), date_to=dt.date(1999, 12, 31),
        amount_le=Decimal("-300000"), moves=star.ledger(spark, folder, *MOVES))


TABLE_FILTER = filters.TableFilter(
    amount_above=Decimal("-300000"), amount_below=Decimal("-1000"), date_from=dt.date(1996, 1, 1),
    date_to=dt.date(2000, 12, 31), type="3-MEDIUM", category="o", payee="SUPPLIER#0000000",
    tags="A, N", status=True)


@query("table_filter")
def table_filter(spark, folder):
    return filters.table_filter(star.ledger(spark, folder), TABLE_FILTER)


@query("filtered_totals")
def filtered_totals(spark, folder):
    return filters.filtered_totals(star.ledger(spark, folder), TABLE_FILTER)


# Table query ---------------------------------------------------------------

COLUMNS = [
    TableColumn("tid", "tid", "numeric", global_search=False),
    TableColumn("date", "date", "yadcf_range_date"),
    TableColumn("amount", "amount", "yadcf_range_number"),
    TableColumn("type", "type", "yadcf_multi_select"),
    TableColumn("category", "category", "yadcf_autocomplete", nulls_order="nullslast"),
    TableColumn("description", "description"),
    TableColumn("payee", "payee", "ilike"),
    TableColumn("subcategory", "subcategory", "like"),
    TableColumn("status", "status", "yadcf_bool_select", global_search=False),
]
NAMES = [c.name for c in COLUMNS]
EVENT_COLUMNS = [
    TableColumn("event_id", "event_id", "none"),
    TableColumn("ts", "ts", "date", global_search=False),
    TableColumn("value", "value", "numeric", global_search=False),
    TableColumn("event_type", "event_type"),
]


def _table(spark, folder, allow_regex=False, search="", regex=False, order=(), start=0, length=-1, **searches):
    request = TableRequest({NAMES.index(n): v for n, v in searches.items()},
                           search, regex, order, start, length)
    return TableQuery(star.ledger(spark, folder), COLUMNS, request, "tid",
                      dt.datetime.combine(AS_OF, dt.time()), allow_regex)


def _events(spark, folder, **searches):
    names = [c.name for c in EVENT_COLUMNS]
    request = TableRequest({names.index(n): v for n, v in searches.items()})
    return TableQuery(star.table(spark, folder, "events"), EVENT_COLUMNS, request, "event_id",
                      dt.datetime.combine(AS_OF, dt.time()))


def _searches(name: str, **searches: str) -> None:
    query(name)(lambda spark, folder: _table(spark, folder, **searches).filtered())


_searches("tq_contains", description="IN")
_searches("tq_like", payee="supplier#%1", subcategory="Brand#1_")
_searches("tq_numeric", tid=">= 5000")
_searches("tq_range_date", date="1996-02-01-yadcf_delim-1998-03-31")
_searches("tq_range_date_open", date="-yadcf_delim-1998-03-31")
_searches("tq_range_number", amount="-250000-yadcf_delim--1000.5")
_searches("tq_range_number_open", amount="100000-yadcf_delim-")
_searches("tq_multi_select", type="1-URGENT|5-LOW")
_searches("tq_bool", status="true")
_searches("tq_exact", category="PROMO")
_searches("tq_column_filters", category="PROMO", amount="-250000-yadcf_delim-", status="false", description="ri")
_searches("tq_global_search", search="brand#1")
_searches("tq_regex_search", allow_regex=True, search="red w||blue|r.g|", regex=True)

FACET_REQUEST = dict(search="e", type="1-URGENT|5-LOW", category="PROMO", amount="-250000-yadcf_delim-",
                     order=[(4, "desc"), (1, "asc")])


def _indexed(spark, folder, **searches):
    """The rows of a search through the text index of a store; the last batch came after the index."""
    ledger, index, rows = run_folder(spark, "ledger"), run_folder(spark, "texts"), star.ledger(spark, folder)
    for i in range(3):
        stores.append_rows(rows.where(F.col("account_id") % 3 == i), ledger)
        if i < 2:
            text_index.catch_up(spark, ledger, index)
    asked = _table(spark, folder, **searches)
    stored = TableQuery(stores.read_ledger(spark, ledger), COLUMNS, asked.request, "tid", asked.as_of, asked.as_regex)
    return _unique(text_index.narrowed(stored, ledger, index).filtered())


@query("tq_global_search_indexed")
def tq_global_search_indexed(spark, folder):
    return _indexed(spark, folder, search="brand#1")


@query("tq_regex_search_indexed")
def tq_regex_search_indexed(spark, folder):
    return _indexed(spark, folder, allow_regex=True, search="red w||blue|r.g|", regex=True)


@query("tq_contains_indexed")
def tq_contains_indexed(spark, folder):
    return _indexed(spark, folder, description="ring", payee="supplier#%1")


@query("tq_date")
def tq_date(spark, folder):
    return _events(spark, folder, ts=">2024-01-03 10:30:00", event_type="i").filtered()


@query("tq_numeric_events")
def tq_numeric_events(spark, folder):
    return _events(spark, folder, value="<12.5").filtered()


@query("tq_sort")
def tq_sort(spark, folder):
    return _table(spark, folder, **FACET_REQUEST).ordered()


@query("tq_page")
def tq_page(spark, folder):
    return _table(spark, folder, **FACET_REQUEST, start=20, length=10).page()


@query("tq_page_deep")
def tq_page_deep(spark, folder):
    return _table(spark, folder, order=[(2, "desc")], start=14_000, length=200).page()


@query("tq_page_rest")
def tq_page_rest(spark, folder):
    return _table(spark, folder, **FACET_REQUEST, start=20).page()


@query("tq_page_index")
def tq_page_index(spark, folder):
    """Two deep pages that follow each other, from one index."""
    pages = [_table(spark, folder, order=[(2, "desc")], start=start, length=100) for start in (14_000, 14_100)]
    index = page_index.build(pages[0], run_folder(spark, "pages"))
    return index.page(pages[0]).unionByName(index.page(pages[1]))


@query("tq_page_following")
def tq_page_following(spark, folder):
    """The page after a row of the middle of the table."""
    table = _table(spark, folder, order=[(3, "asc"), (2, "desc")], length=200)
    return table.following({"type": "3-MEDIUM", "amount": Decimal("1000.00"), "tid": 5000})


@query("tq_counts")
def tq_counts(spark, folder):
    return _table(spark, folder, **FACET_REQUEST).counts()


@query("tq_facet_range")
def tq_facet_range(spark, folder):
    return _table(spark, folder, **FACET_REQUEST).facet_ranges()


@query("tq_facet_values")
def tq_facet_values(spark, folder):
    return _table(spark, folder, **FACET_REQUEST).facet_values()


# Lookups -------------------------------------------------------------------

@query("user_accounts")
def user_accounts(spark, folder):
    return lookups.user_accounts(star.users(spark, folder), star.accounts(spark, folder))


@query("held_accounts")
def held_accounts(spark, folder):
    return lookups.held_accounts(star.users(spark, folder), star.accounts(spark, folder))


@query("holder_transactions")
def holder_transactions(spark, folder):
    return lookups.holder_transactions(
        star.users(spark, folder), star.accounts(spark, folder), star.ledger(spark, folder),
        key_counts(star.ledger(spark, folder, "account_id"), ["account_id"]))


@query("dimension_lists")
def dimension_lists(spark, folder):
    return lookups.dimension_lists({
        kind: star.ledger(spark, folder, kind).select(F.col(kind).alias("name")).dropna().distinct()
        for kind in ("type", "category", "subcategory")})


@query("resolve_dimension_ids")
def resolve_dimension_ids(spark, folder):
    return lookups.resolve_ids(inputs.entries(spark, folder))


@query("effective_categories")
def effective_categories(spark, folder):
    return budgets.effective_subjects(
        star.accounts(spark, folder), star.budgets(spark, folder), CATEGORIES.values())


@query("seed_budgets_subcategory")
def seed_budgets_subcategory(spark, folder):
    return budgets.seed_budgets(
        star.accounts(spark, folder), star.budgets(spark, folder, "subcategory"), SUBCATEGORIES.values())


@query("seed_budgets")
def seed_budgets(spark, folder):
    return budgets.seed_budgets(
        star.accounts(spark, folder), star.budgets(spark, folder), CATEGORIES.values())


@query("budget_listing")
def budget_listing(spark, folder):
    return budgets.budget_listing(
        star.budgets(spark, folder), star.budgets(spark, folder, "subcategory"))


# Balances ------------------------------------------------------------------

@query("account_overview")
def account_overview(spark, folder):
    return balances.account_overview(
        star.accounts(spark, folder), star.ledger(spark, folder, "account_id", "amount", "status"))


@query("portfolio_total")
def portfolio_total(spark, folder):
    return balances.portfolio_total(
        star.accounts(spark, folder), star.ledger(spark, folder, "account_id", "amount", "status"))


@query("running_balance")
def running_balance(spark, folder):
    return balances.running_balance(_done(spark, folder, *MOVES), star.openings(spark, folder))


@query("ledger_log")
def ledger_log(spark, folder):
    return balances.ledger_log(
        star.ledger(spark, folder), star.openings(spark, folder))


@query("running_balance_unnumbered")
def running_balance_unnumbered(spark, folder):
    """Rows that are alone on their date have lost their id; they count in their place all the same."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("account_id", "date")) == 1
    rows = _done(spark, folder, *MOVES).withColumn("tid", F.when(~alone, F.col("tid")))
    return balances.running_balance(rows, star.openings(spark, folder))


@query("closing_balance_year")
def closing_balance_year(spark, folder):
    return balances.closing_by_year(_done(spark, folder, *MOVES), star.openings(spark, folder))


def _closings(name: str, f, trailing: int | None) -> None:
    query(name)(lambda spark, folder: f(
        _done(spark, folder, *MOVES), star.openings(spark, folder), trailing))


for _span, _months in (("month", None), ("l12m", 12), ("l3m", 3)):
    _closings(f"closing_balance_{_span}", balances.closing_by_month, _months)
    _closings(f"closing_balance_{_span}_outgo", balances.closing_by_month_outgo, _months)
    if _months:
        query(f"trailing_months_{_months}")(
            lambda spark, folder, n=_months: filters.trailing_months(_done(spark, folder, *MOVES), n))
query("trailing_months_24")(
    lambda spark, folder: filters.trailing_months(_done(spark, folder, *MOVES), 24))


@query("latest_transactions")
def latest_transactions(spark, folder):
    return filters.latest_rows(
        star.ledger(spark, folder), AS_OF, star.ledger(spark, folder, "account_id", "date"))


# Sums by period ------------------------------------------------------------

def _cells(spark, folder, subject, period="month", trailing=None, only_outgo=False):
    rows = _done(spark, folder, "account_id", "date", "amount", subject)
    return shares.spend_by_period(
        filters.outgo(rows) if only_outgo else rows, subject, period, trailing)


SPANS = {"year": ("year", None), "month": ("month", None), "l12m": ("month", 12), "l3m": ("month", 3)}
for _subject in SUBJECTS:
    for _span, (_period, _months) in SPANS.items():
        for _suffix, _only in (("", False), ("_outgo", True)):
            query(f"spend_by_period_{_subject}_{_span}{_suffix}")(partial(
                _cells, subject=_subject, period=_period, trailing=_months, only_outgo=_only))
    for _span, (_period, _months) in SPANS.items():
        # The keys of a year have no span in their names.
        _end = "" if _span == "year" else f"_{_span}"
        for _suffix, _only in (("", False), ("_outgo", True)):
            query(f"pivot_{_subject}{_end}{_suffix}")(
                lambda spark, folder, s=_subject, p=_period, n=_months, o=_only: shares.pivot(_cells(spark, folder, s, p, n, o)))
        query(f"percent_of_income_{_subject}{_end}")(
            lambda spark, folder, s=_subject, p=_period, n=_months: shares.percent_of_income(_cells(spark, folder, s, p, n)))
    query("spend_share" if _subject == "category" else f"spend_share_{_subject}")(lambda spark, folder, s=_subject: shares.spend_share(
        _cells(spark, folder, s, "month")))


@query("pivot_tag_wide")
def pivot_tag_wide(spark, folder):
    """The grouped pivot of all payees as subjects, told as the number and sum of its cells."""
    rows = _done(spark, folder, "account_id", "date", "amount", "payee")
    cells = shares.spend_by_period(rows.withColumnRenamed("payee", "tag"), "tag", "year")
    wide = shares.pivot_groups(cells, 50)
    nets = F.map_values("nets")
    total = F.aggregate(nets, F.lit(0).cast("decimal(28,2)"), lambda a, b: (a + b).cast("decimal(28,2)"))
    return wide.groupBy("account_id", "period").agg(
        F.sum(F.size(nets)).alias("n_subjects"), F.sum(total).cast("decimal(28,2)").alias("net"))


# Budgets -------------------------------------------------------------------

@query("average_monthly_income")
def average_monthly_income(spark, folder):
    return budgets.average_monthly_income(_done(spark, folder, "account_id", "date", "amount", "tag"))


for _subject in ("category", "subcategory"):
    query(f"last_month_{_subject}")(lambda spark, folder, s=_subject: budgets.last_month(
        _done(spark, folder, "account_id", "date", "amount", s), s))
    query(f"avg_month_{_subject}")(lambda spark, folder, s=_subject: budgets.average_month(
        _done(spark, folder, "account_id", "date", "amount", s), s))


def _refresh(spark, folder, subject):
    return budgets.refresh_budgets(
        star.budgets(spark, folder, subject),
        _done(spark, folder, "account_id", "date", "amount", subject), subject)


query("refresh_budgets")(partial(_refresh, subject="category"))
query("refresh_budgets_subcategory")(partial(_refresh, subject="subcategory"))


@query("budget_gauge")
def budget_gauge(spark, folder):
    return budgets.budget_gauge(
        star.accounts(spark, folder), _done(spark, folder, *MOVES, *SUBJECTS),
        star.budgets(spark, folder), star.budgets(spark, folder, "subcategory"), AS_OF)


# Schedules -----------------------------------------------------------------

def _due(frequency: str) -> Query:
    return lambda spark, folder: schedules.with_due(
        star.schedules(spark, folder).where(F.col("frequency") == frequency)
    ).select("id", "interval_n", "day", "start_date", "end_date", "due")


for _frequency in ("Monthly", "Weekly", "Yearly"):
    query(f"next_due_{_frequency.lower()}")(_due(_frequency))


def _due_of(spark, folder, **changes):
    rows = star.schedules(spark, folder).withColumns(changes)
    return schedules.with_due(rows).select("id", "frequency", "interval_n", "day", "start_date", "end_date", "due")


@query("next_due_quarterly")
def next_due_quarterly(spark, folder):
    return _due_of(spark, folder, frequency=F.lit("Quarterly"), end_date=F.add_months("start_date", 60))


@query("next_due_from_month_end")
def next_due_from_month_end(spark, folder):
    """Days counted from the end of the month, and day 0; rules without an end."""
    return _due_of(spark, folder, frequency=F.lit("Monthly"), day=-(F.col("day") % 5), end_date=F.lit(None).cast("date"))


@query("next_due_long_interval")
def next_due_long_interval(spark, folder):
    """Every 240 years, from 1850 on."""
    start = F.add_months(F.lit("1850-12-15").cast("date"), -(F.col("id") % 12).cast("int"))
    return _due_of(spark, folder, frequency=F.lit("Yearly"), interval_n=F.lit(240), start_date=start, end_date=F.lit(None).cast("date"))


@query("upcoming_transactions")
def upcoming_transactions(spark, folder):
    return schedules.listed_upcoming(star.schedules(spark, folder))


@query("post_due")
def post_due(spark, folder):
    return schedules.post_due(
        star.schedules(spark, folder), inputs.decisions(spark, folder), AS_OF)[0]


@query("advance_schedules")
def advance_schedules(spark, folder):
    return schedules.post_due(
        star.schedules(spark, folder), inputs.decisions(spark, folder), AS_OF)[1]


@query("reschedule")
def reschedule(spark, folder):
    return schedules.reschedule(star.schedules(spark, folder), inputs.decisions(spark, folder))


@query("schedule_listing")
def schedule_listing(spark, folder):
    return schedules.schedule_listing(star.schedules(spark, folder))


# Stored state --------------------------------------------------------------

def _kept(spark, folder):
    """A ledger that ends as the given one after three batches, a replaced batch, edits and a deletion, and its sums, brought up to
    date after each change."""
    ledger, sums = run_folder(spark, "ledger"), run_folder(spark, "sums")
    rows = stored(star.ledger(spark, folder), "rows")  # used five times

    def part(k: int) -> DataFrame:
        return rows.where(F.col("tid") % 3 == k)

    def edited(wrong: bool) -> DataFrame:
        of = stores.read_ledger(spark, ledger).where("tid % 5 = 0 and account_id % 11 = 0")
        return of.withColumn("amount", -F.col("amount")).withColumn("seq", F.lit(1 + wrong))

    steps = [
        lambda: stores.append_rows(part(0), ledger, "first"),
        lambda: stores.append_rows(part(1).withColumn("amount", -F.col("amount")), ledger, "second"),
        lambda: stores.append_rows(part(2).unionByName(part(0).where(F.col("account_id") % 7 == 0).withColumn("payee", F.lit("to go"))), ledger, "third"),
        lambda: stores.append_rows(part(1), ledger, "second"),
        lambda: stores.edit_ledger(spark, ledger, edited(True)),
        lambda: stores.edit_ledger(spark, ledger, edited(False)),
        lambda: stores.remove_rows(spark, ledger, stores.read_ledger(spark, ledger).where("payee = 'to go'")),
    ]
    for step in steps:
        step()
        kept.catch_up(spark, ledger, sums)
    return ledger, sums


def _kept_rows(spark, folder):
    return kept.as_rows(kept.read_cells(spark, _kept(spark, folder)[1]))


@query("account_overview_kept")
def account_overview_kept(spark, folder):
    return kept.account_overview(star.accounts(spark, folder), kept.read_cells(spark, _kept(spark, folder)[1]))


@query("refresh_budgets_kept")
def refresh_budgets_kept(spark, folder):
    """Budgets in a store, refreshed from the sums and read again."""
    ledger, sums = _kept(spark, folder)
    store = keyed.budgets_at(spark, run_folder(spark, "budgets"))
    store.create(star.budgets(spark, folder), lots=8)
    promotion.refresh_stored(spark, store.path, ledger, sums, "category")
    return store.read()


@query("closing_balance_month_kept")
def closing_balance_month_kept(spark, folder):
    return balances.closing_by_month(_kept_rows(spark, folder), star.openings(spark, folder))


@query("percent_of_income_category_kept")
def percent_of_income_category_kept(spark, folder):
    return shares.percent_of_income(shares.spend_by_period(_kept_rows(spark, folder), "category", "year"))


@query("average_monthly_income_kept")
def average_monthly_income_kept(spark, folder):
    return budgets.average_monthly_income(_kept_rows(spark, folder))


@query("running_balance_since")
def running_balance_since(spark, folder):
    """The running balance from a day inside a month on, from the sums and the stored rows of that span."""
    ledger, sums = _kept(spark, folder)
    listed = kept.running_balance_since(spark, ledger, sums, star.openings(spark, folder), dt.date(1997, 5, 17))
    # The balance at the end of each day does not depend on the stored ids.
    return listed.groupBy("account_id", "date").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max_by("closing_balance", "tid").alias("closing_balance"))


@query("schedule_store")
def schedule_store(spark, folder):
    """Stored schedules edited, then approved and moved on; the run is repeated and changes nothing."""
    path, ledger = run_folder(spark, "schedules"), run_folder(spark, "ledger")
    keyed.schedules_at(spark, path).create(star.schedules(spark, folder), lots=8)
    for _ in range(2):
        promotion.post_due_store(spark, path, ledger, inputs.decisions(spark, folder), AS_OF, "july")
    promotion.edit_schedules(spark, path, inputs.schedule_edits(spark, folder))
    return schedules.schedule_listing(keyed.schedules_at(spark, path).read())


@query("post_due_store")
def post_due_store(spark, folder):
    """What the repeated run has put into the ledger."""
    path, ledger = run_folder(spark, "schedules"), run_folder(spark, "ledger")
    keyed.schedules_at(spark, path).create(star.schedules(spark, folder), lots=8)
    for _ in range(2):
        promotion.post_due_store(spark, path, ledger, inputs.decisions(spark, folder), AS_OF, "july")
    return _unique(stores.read_ledger(spark, ledger))


@query("budget_store")
def budget_store(spark, folder):
    """Edits of stored budgets, a new subject among them, written back and read again."""
    store = keyed.budgets_at(spark, run_folder(spark, "budgets"))
    store.create(star.budgets(spark, folder), lots=8)
    promotion.edit_budgets(spark, store.path, inputs.budget_edits(spark, folder))
    return store.read()


# Incremental ingest --------------------------------------------------------

@query("incremental_ingest")
def incremental_ingest(spark, folder):
    """All exports arrive and are ingested, then arrive again: nothing is added."""
    ledger, progress = run_folder(spark, "ledger"), run_folder(spark, "progress")
    arriving = inputs.homebank_files(spark, folder)
    account = F.col("info").cast("long")
    ingest_new_files(spark, arriving, ledger, progress, account=account)
    inputs.homebank_files(spark, folder, arriving)
    ingest_new_files(spark, arriving, ledger, progress, account=account)
    return stored_rows(spark, ledger).drop("tid", "year", "batch")
