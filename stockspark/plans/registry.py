"""Binds every operator to the fixture tables and fixed parameters.

``QUERIES[key](spark, sf_dir) -> DataFrame``; the oracle SQL for the same key
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import changes as E
from ..operators import listings as B
from ..operators import quality as Q
from ..operators import raw_quality as RQ
from ..operators import reports as C
from ..schemas import BACKUP_TABLES
from ..session import checkpoint_dir, tune_session
from ..sources import backup as A
from ..sources import document as DOC
from ..sources import migration as M
from ..sources import requests as R
from ..sources import search_index as SI
from ..sources.buckets import bucketed
from ..sources.fixtures import Tables
from ..streaming import streams as ST
from . import params as P

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def _run(fn: Callable[[Tables], DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    # UTC session zone and AQE, unless the caller has set them.
    tune_session(spark)
    return fn(Tables(spark, sf_dir))


def register(key: str):
    def deco(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir, _fn=fn: _run(_fn, spark, sf_dir)
        return fn

    return deco


# ---------------------------------------------------------------- B listings
register("categories_list")(lambda t: B.categories_list(t.categories))
register("inventory_list")(lambda t: B.inventory_list(t.inventory, t.categories))
register("inventory_item")(lambda t: B.inventory_item(t.inventory, t.categories, P.ITEM_ID))
register("category_by_id")(lambda t: B.category_by_id(t.categories, P.CATEGORY_ID))
register("inventory_search")(lambda t: B.inventory_search(t.inventory, t.categories, P.SEARCH_TERM))
register("inventory_search_wildcard")(lambda t: B.inventory_search(t.inventory, t.categories, P.SEARCH_WILDCARD))
register("inventory_search_contains")(
    lambda t: B.inventory_search_contains(t.inventory, t.categories, P.SEARCH_TERM)
)
register("inventory_by_category_filter")(
    lambda t: B.inventory_by_category_filter(t.inventory, t.categories, P.CATEGORY_ID)
)
register("low_stock_items")(lambda t: B.low_stock_items(t.inventory, t.categories))
register("low_stock_alert")(lambda t: B.low_stock_alert(t.inventory, t.categories))
register("low_stock_alerts_top10")(lambda t: B.low_stock_alerts_top10(t.inventory, t.categories))
register("low_stock_deficit")(lambda t: B.low_stock_deficit(t.inventory, t.categories))
register("sales_list")(lambda t: B.sales_list(t.sales, t.inventory, t.staff))
register("sale_by_id")(lambda t: B.sale_by_id(t.sales, t.inventory, t.staff, P.SALE_ID))
register("sales_date_range")(
    lambda t: B.sales_date_range(t.sales, t.inventory, t.staff, P.DATE_START, P.DATE_END)
)
register("sales_by_payment")(lambda t: B.sales_by_payment(t.sales, t.inventory, t.staff, P.PAYMENT_METHOD))
register("customer_history")(lambda t: B.customer_history(t.sales, t.inventory, P.CUSTOMER_TERM))
register("staff_list")(lambda t: B.staff_list(t.staff))
register("staff_active")(lambda t: B.staff_active(t.staff))
register("staff_by_department")(lambda t: B.staff_by_department(t.staff, P.DEPARTMENT))
register("staff_by_id")(lambda t: B.staff_by_id(t.staff, P.STAFF_ID))
register("staff_sales_detail")(lambda t: B.staff_sales_detail(t.sales, t.inventory, P.STAFF_ID))
register("budgets_list")(lambda t: B.budgets_list(t.budget))
register("budget_by_id")(lambda t: B.budget_by_id(t.budget, P.BUDGET_ID))
register("budgets_by_category")(lambda t: B.budgets_by_category(t.budget, P.BUDGET_CATEGORY))
register("budgets_by_month")(lambda t: B.budgets_by_month(t.budget, P.BUDGET_MONTH))
register("transactions_list")(lambda t: B.transactions_list(t.transactions, t.staff))
register("transactions_by_type")(lambda t: B.transactions_by_type(t.transactions, t.staff, P.TRANSACTION_TYPE))
register("transactions_by_category")(
    lambda t: B.transactions_by_category(t.transactions, t.staff, P.TRANSACTION_CATEGORY)
)
register("budget_vs_actual")(lambda t: B.budget_vs_actual(t.budget, P.BUDGET_CATEGORY, P.AS_OF_BUDGET))
register("recent_sales_top5")(lambda t: B.recent_sales_top5(t.sales, t.inventory, t.staff))
register("items_with_category_audit")(lambda t: B.items_with_category_audit(t.inventory, t.categories))
register("sales_category_audit")(lambda t: B.sales_category_audit(t.sales, t.inventory, t.categories))
register("items_by_category_inner")(lambda t: B.items_by_category_inner(t.inventory, t.categories))
register("stock_status")(lambda t: B.stock_status(t.inventory, t.categories))
register("budget_status")(lambda t: B.budget_status(t.budget))
register("sales_display")(lambda t: B.sales_display(t.sales, t.inventory, t.staff))

# ----------------------------------------------------------------- C reports
register("inventory_summary")(lambda t: C.inventory_summary(t.inventory))
register("inventory_by_category")(lambda t: C.inventory_by_category(t.categories, t.inventory))
register("sales_summary")(lambda t: C.sales_summary(t.sales))
register("sales_by_date")(lambda t: C.sales_by_date(t.sales, P.DATE_START, P.DATE_END))
register("staff_performance")(lambda t: C.staff_performance(t.staff, t.sales))
register("staff_sales_totals")(lambda t: C.staff_sales_totals(t.staff, t.sales, t.inventory))
register("top_selling_items")(lambda t: C.top_selling_items(t.inventory, t.sales))
register("top_items")(lambda t: C.top_items(t.sales, t.inventory))
register("top_items_ranked")(lambda t: C.top_items_ranked(t.sales, t.inventory))
register("monthly_trend")(lambda t: C.monthly_trend(t.sales, P.TREND_YEAR))
register("monthly_trend_filled")(lambda t: C.monthly_trend_filled(t.sales, P.FILLED_YEAR))
register("daily_sales_30d")(lambda t: C.daily_sales_30d(t.sales, P.AS_OF_DAILY))
register("yearly_revenue")(lambda t: C.yearly_revenue(t.sales))
register("sales_by_category")(lambda t: C.sales_by_category(t.categories, t.inventory, t.sales))
register("profit_margin")(lambda t: C.profit_margin(t.inventory, t.sales))
register("supplier_performance")(lambda t: C.supplier_performance(t.inventory))
register("comprehensive")(lambda t: C.comprehensive(t.inventory, t.sales, t.staff))
register("budget_summary")(lambda t: C.budget_summary(t.budget))
register("budget_summary_month")(lambda t: C.budget_summary(t.budget, P.BUDGET_MONTH))
register("budget_summary_status")(lambda t: C.budget_summary_status(t.budget, P.BUDGET_MONTH))
register("dashboard_kpis")(lambda t: C.dashboard_kpis(t.inventory, t.sales, t.staff))
register("setup_counts")(lambda t: C.setup_counts(t.inventory, t.categories, t.staff, t.sales))
register("uncategorised_count")(lambda t: C.uncategorised_count(t.inventory))

# ------------------------------------------------------- E write jobs, F, G


register("category_insert")(lambda t: E.category_insert(t.categories, R.category_requests(t), R.JOB_TIME).extra["added"])
register("category_insert_rejects")(lambda t: E.category_insert(t.categories, R.category_requests(t)).rejects)
register("category_dedupe")(lambda t: E.category_dedupe(t.categories_dirty, t.inventory).extra["mapping"])
register("category_dedupe_categories")(lambda t: E.category_dedupe(t.categories_dirty, t.inventory).snapshot)
register("category_dedupe_inventory")(
    lambda t: E.category_dedupe(t.categories_dirty, R.inventory_of_duplicates(t)).extra["inventory"]
)
register("category_update")(lambda t: E.category_update(t.categories, R.category_update_requests(t)).snapshot)
register("category_update_rejects")(lambda t: E.category_update(t.categories, R.category_update_requests(t)).rejects)
register("category_delete")(
    lambda t: E.category_delete(t.categories, t.inventory, R.category_delete_requests(t)).snapshot
)
register("category_delete_rejects")(
    lambda t: E.category_delete(t.categories, t.inventory, R.category_delete_requests(t)).rejects
)
register("inventory_insert")(
    lambda t: E.inventory_insert(t.inventory, R.inventory_insert_requests(t), R.JOB_TIME).extra["added"]
)
register("inventory_insert_rejects")(
    lambda t: E.inventory_insert(t.inventory, R.inventory_insert_requests(t)).rejects
)
register("inventory_update")(
    lambda t: E.inventory_update(t.inventory, R.inventory_update_requests(t), R.JOB_TIME).snapshot
)
register("inventory_update_rejects")(
    lambda t: E.inventory_update(t.inventory, R.inventory_update_requests(t), R.JOB_TIME).rejects
)
register("staff_delete")(lambda t: E.rows_delete(t.staff, R.staff_delete_requests(t)).snapshot)
register("staff_delete_rejects")(lambda t: E.rows_delete(t.staff, R.staff_delete_requests(t)).rejects)
register("budget_delete")(lambda t: E.rows_delete(t.budget, R.budget_delete_requests(t)).snapshot)
register("budget_delete_rejects")(lambda t: E.rows_delete(t.budget, R.budget_delete_requests(t)).rejects)
register("rows_delete")(lambda t: E.rows_delete(t.inventory, R.rows_delete_requests(t)).snapshot)
register("rows_delete_rejects")(lambda t: E.rows_delete(t.inventory, R.rows_delete_requests(t)).rejects)
register("stock_adjust")(lambda t: E.stock_adjust(t.inventory, t.stock_ops, R.JOB_TIME).snapshot)
register("stock_adjust_rejects")(lambda t: E.stock_adjust(t.inventory, t.stock_ops).rejects)
register("sale_post")(lambda t: E.sale_post(t.inventory, t.sale_requests).extra["outcomes"])
register("sale_post_stock")(lambda t: E.sale_post(t.inventory, t.sale_requests, R.JOB_TIME).snapshot)
register("sale_post_accepted")(lambda t: E.sale_post(t.inventory, t.sale_requests, R.JOB_TIME, t.sales).extra["accepted"])
# Same job in small slices; then on a few items with very many requests each, so that every item spans many slices.
register("sale_post_hot")(lambda t: E.sale_post(t.inventory, t.sale_requests, slice_rows=2000).extra["outcomes"])
register("sale_post_busy")(
    lambda t: E.sale_post(R.busy_inventory(t), R.busy_requests(t), slice_rows=500).extra["outcomes"]
)
register("sale_update")(lambda t: E.sale_update(t.sales, R.sale_update_requests(t)).snapshot)
register("sale_update_rejects")(lambda t: E.sale_update(t.sales, R.sale_update_requests(t)).rejects)
register("sale_delete")(
    lambda t: E.sale_delete(t.sales, t.inventory, R.sale_delete_requests(t), R.JOB_TIME).extra["inventory"]
)
register("sale_delete_sales")(lambda t: E.sale_delete(t.sales, t.inventory, R.sale_delete_requests(t)).snapshot)
register("sale_delete_rejects")(lambda t: E.sale_delete(t.sales, t.inventory, R.sale_delete_requests(t)).rejects)
register("staff_insert")(lambda t: E.staff_insert(t.staff, R.staff_insert_requests(t), R.JOB_TIME).extra["added"])
register("staff_insert_rejects")(lambda t: E.staff_insert(t.staff, R.staff_insert_requests(t)).rejects)
register("staff_update")(lambda t: E.staff_update(t.staff, R.staff_update_requests(t)).snapshot)
register("staff_update_rejects")(lambda t: E.staff_update(t.staff, R.staff_update_requests(t)).rejects)
register("staff_status_update_rejects")(lambda t: E.staff_status_update(t.staff, R.staff_status_requests(t)).rejects)
register("staff_status_update")(lambda t: E.staff_status_update(t.staff, R.staff_status_requests(t)).snapshot)
register("budget_insert")(lambda t: E.budget_insert(t.budget, R.budget_insert_requests(t), R.JOB_TIME).extra["added"])
register("budget_insert_rejects")(lambda t: E.budget_insert(t.budget, R.budget_insert_requests(t)).rejects)
register("budget_update")(lambda t: E.budget_update(t.budget, R.budget_update_requests(t)).snapshot)
register("budget_update_rejects")(lambda t: E.budget_update(t.budget, R.budget_update_requests(t)).rejects)
register("transaction_post_rejects")(
    lambda t: E.transaction_post(t.budget, t.transactions, R.transaction_requests(t)).rejects
)
register("transaction_post_transactions")(
    lambda t: E.transaction_post(t.budget, t.transactions, R.transaction_requests(t)).extra["transactions"]
)
register("transaction_post")(
    lambda t: E.transaction_post(t.budget, t.transactions, R.transaction_requests(t)).snapshot
)
register("remap_categories")(
    lambda t: E.remap_categories(t.inventory, t.categories, R.remap_mapping(t), R.REMAP_DEFAULT)
)

register("validate_inventory")(lambda t: Q.report(R.inventory_insert_requests(t), Q.INVENTORY_RULES, "seq"))
register("validate_inventory_counts")(lambda t: Q.rule_counts(R.inventory_insert_requests(t), Q.INVENTORY_RULES))
register("validate_sales")(lambda t: Q.report(R.sale_checks(t), Q.SALES_RULES))
register("validate_sales_counts")(lambda t: Q.rule_counts(R.sale_checks(t), Q.SALES_RULES))
register("validate_staff")(lambda t: Q.report(t.staff, Q.STAFF_RULES))
register("validate_staff_counts")(lambda t: Q.rule_counts(t.staff, Q.STAFF_RULES))
register("validate_budget")(lambda t: Q.report(R.budget_insert_requests(t), Q.BUDGET_RULES, "seq"))
register("validate_budget_counts")(lambda t: Q.rule_counts(R.budget_insert_requests(t), Q.BUDGET_RULES))
register("validate_transactions")(lambda t: Q.report(R.transaction_requests(t), Q.TRANSACTION_RULES, "seq"))
register("validate_transactions_counts")(lambda t: Q.rule_counts(R.transaction_requests(t), Q.TRANSACTION_RULES))
for _kind in RQ.RULES:
    register(f"validate_{_kind}_raw")(lambda t, k=_kind: RQ.report(R.raw_bodies(t, k), k))
    register(f"validate_{_kind}_raw_counts")(lambda t, k=_kind: RQ.rule_counts(R.raw_bodies(t, k), k))


def _form_b(budget):
    return A.budget_as_form_b(budget)


def _form_a(form_b):
    return form_b.select(
        "id",
        "category",
        F.col("allocated_amount").alias("amount"),
        F.col("spent_amount").alias("spent"),
        S.format_month_year("year", "month").alias("month_year"),
        "created_at",
    )


register("budget_to_form_b")(lambda t: _form_b(t.budget))
register("budget_to_form_a")(lambda t: _form_a(_form_b(t.budget)))

# ------------------------------------------------- A sources/sinks, S streams


# Arrival waves for the streaming demos: requests/sales before 1997, 1997-1999, from 2000.
WAVE_YEARS = [1997, 2000]


def scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/stockspark/{name}-{uuid.uuid4().hex}"


def _backup_tables(t: Tables) -> dict:
    return {name: getattr(t, name) for name in BACKUP_TABLES}


def _waves(df, ts_col: str):
    bounds = [None, *WAVE_YEARS, None]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.year(ts_col) >= lo)
        if hi is not None:
            cond = cond & (F.year(ts_col) < hi)
        yield df.filter(cond)


def _search(t: Tables, table: DataFrame, columns: list[str], term: str, like: bool = True) -> DataFrame:
    """Rows found through a trigram index that is built for the stored table."""
    path = os.path.dirname(table.inputFiles()[0])
    index = scratch(t.spark, "trigrams")
    SI.write_index(t.spark, path, columns, index)
    return SI.search(t.spark, path, index, columns, term, like)


_INDEXED = ["name", "description", "sku"]
register("inventory_search_indexed")(
    lambda t: B.inventory_search(_search(t, t.inventory, _INDEXED, P.SEARCH_TERM), t.categories, P.SEARCH_TERM)
)
register("inventory_search_wildcard_indexed")(
    lambda t: B.inventory_search(_search(t, t.inventory, _INDEXED, P.SEARCH_WILDCARD), t.categories, P.SEARCH_WILDCARD)
)
register("inventory_search_contains_indexed")(
    lambda t: B.inventory_search_contains(
        _search(t, t.inventory, _INDEXED, P.SEARCH_TERM, like=False), t.categories, P.SEARCH_TERM
    )
)
register("customer_history_indexed")(
    lambda t: B.customer_history(_search(t, t.sales, ["customer_name"], P.CUSTOMER_TERM), t.inventory, P.CUSTOMER_TERM)
)
# Write jobs on tables bucketed by id: only the requests are shuffled.
register("sale_update_bucketed")(lambda t: E.sale_update(bucketed(t.sales), R.sale_update_requests(t)).snapshot)
register("sale_delete_sales_bucketed")(
    lambda t: E.sale_delete(bucketed(t.sales), t.inventory, R.sale_delete_requests(t)).snapshot
)
register("rows_delete_bucketed")(lambda t: E.rows_delete(bucketed(t.inventory), R.rows_delete_requests(t)).snapshot)

register("table_row_counts")(lambda t: A.table_row_counts(_backup_tables(t)))
register("table_preview")(lambda t: A.table_preview(_backup_tables(t), "sales"))
@register("backup_export")
def _backup_export(t: Tables):
    """Write the backup, compressed: JSON lines take many times the space of the stored tables."""
    manifest = A.write_backup(_backup_tables(t), scratch(t.spark, "backup"), compression="gzip")
    return manifest.select("table", F.col("rows").cast("bigint").alias("rows"), "version", "source")


@register("backup_restore")
def _backup_restore(t: Tables):
    root = scratch(t.spark, "backup")
    A.write_backup(_backup_tables(t), root)
    _, status = A.read_backup(t.spark, root)
    return status


@register("backup_round_trip")
def _backup_round_trip(t: Tables):
    root = scratch(t.spark, "backup")
    tables = _backup_tables(t)
    A.write_backup(tables, root, compression="gzip")
    restored, _ = A.read_backup(t.spark, root)
    return A.round_trip_diff(tables, restored)


@register("backup_verify")
def _backup_verify(t: Tables):
    root = scratch(t.spark, "backup")
    A.write_backup(_backup_tables(t), root)
    return A.verify_backup(t.spark, root)


@register("backup_document_restore")
def _backup_document_restore(t: Tables):
    root = scratch(t.spark, "document")
    DOC.write_document(_backup_tables(t), root, compression="gzip")
    return DOC.read_backup_document(t.spark, root)[1]


@register("backup_document_round_trip")
def _backup_document_round_trip(t: Tables):
    root = scratch(t.spark, "document")
    tables = _backup_tables(t)
    DOC.write_document(tables, root, compression="gzip")
    return A.round_trip_diff(tables, DOC.read_backup_document(t.spark, root)[0])


register("conform_to_schema")(lambda t: M.migrate({n: A.as_text(df) for n, df in _backup_tables(t).items()}).report)
# The same tables with rows that break every kind of constraint.
register("migrate_report")(lambda t: M.migrate(R.migration_sources(t)).report)
register("migrate_rejects")(lambda t: M.migrate(R.migration_sources(t)).rejects)
register("migrate_categories")(lambda t: M.migrate(R.migration_sources(t)).tables["categories"])
register("seed_categories")(lambda t: A.seed_categories(t.categories))
register("column_evolution")(
    lambda t: A.column_evolution(
        t.inventory.drop("description", "sku").withColumnRenamed("min_quantity", "minimum_stock")
    )
)


@register("sale_post_stream")
def _sale_post_stream(t: Tables):
    spark = t.spark
    root = scratch(spark, "sale-stream")
    ST.init_stock_state(t.inventory, f"{root}/state")
    for wave in _waves(t.sale_requests, "requested_at"):
        wave.write.mode("append").parquet(f"{root}/requests")
        q = ST.start_sale_post_stream(spark, f"{root}/requests", f"{root}/state", f"{root}/checkpoint")
        q.awaitTermination()
    return ST.read_outcomes(spark, f"{root}/state")


@register("daily_sales_stream")
def _daily_sales_stream(t: Tables):
    spark = t.spark
    root = scratch(spark, "daily-stream")
    for wave in _waves(t.sales, "sale_date"):
        wave.write.mode("append").parquet(f"{root}/sales")
        q = ST.start_daily_sales_stream(spark, f"{root}/sales", f"{root}/out", f"{root}/checkpoint")
        q.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@register("daily_sales_stream_open_days")
def _daily_sales_stream_open_days(t: Tables):
    spark = t.spark
    root = scratch(spark, "daily-stream")
    for wave in _waves(t.sales, "sale_date"):
        wave.write.mode("append").parquet(f"{root}/sales")
        q = ST.start_daily_sales_stream(spark, f"{root}/sales", f"{root}/out", f"{root}/checkpoint", open_days=True)
        q.awaitTermination()
    return ST.read_daily_sales(spark, f"{root}/out")
