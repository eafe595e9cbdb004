"""Aggregations and reports.

Scale notes: fact tables (sales, inventory) are aggregated by their join key
*before* they meet a dimension, so the shuffle carries one partial row per
key and task instead of every sale (partial + final HashAggregate), and the
join sees one row per key.  Global aggregates are single-row plans that
need no shuffle of rows; several of them are combined in one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def _zero_money():
    return F.lit(0).cast("decimal(20,2)")


# C1
def inventory_summary(inventory: DataFrame) -> DataFrame:
    return inventory.agg(
        F.count(F.lit(1)).alias("total_items"),
        S.int_sum("quantity").alias("total_stock"),
        S.value_sum("quantity", "unit_price").alias("total_value"),
        F.count_if(F.col("quantity") <= F.col("min_quantity")).alias("low_stock_items"),
    )


# C2
def inventory_by_category(categories: DataFrame, inventory: DataFrame) -> DataFrame:
    per_cat = inventory.groupBy("category_id").agg(
        F.count("id").alias("item_count"),
        S.int_sum("quantity").alias("total_stock"),
        S.value_sum("quantity", "unit_price").alias("total_value"),
    )
    cats = categories.select("id", F.col("name").alias("category"))
    return (
        cats.join(per_cat, cats.id == per_cat.category_id, "left")
        .select(
            "id",
            "category",
            F.coalesce("item_count", F.lit(0).cast("bigint")).alias("item_count"),
            "total_stock",
            "total_value",
        )
        .orderBy(F.col("total_value").desc_nulls_last(), "id")
        .drop("id")
    )


def _sales_totals(sales: DataFrame) -> list:
    return [
        F.count(F.lit(1)).alias("total_sales"),
        S.money_sum("total_price").alias("total_revenue"),
        S.int_sum("quantity").alias("total_items_sold"),
        S.mean("total_price").alias("average_sale_value"),
    ]


# C3
def sales_summary(sales: DataFrame) -> DataFrame:
    return sales.agg(*_sales_totals(sales))


# C4: the timestamp itself is compared, so the end day counts up to 00:00.
def sales_by_date(sales: DataFrame, start: str, end: str) -> DataFrame:
    lo, hi = F.to_timestamp_ntz(F.lit(start)), F.to_timestamp_ntz(F.lit(end))
    return (
        sales.filter(F.col("sale_date").between(lo, hi))
        .groupBy(S.day("sale_date").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("sales_count"),
            S.money_sum("total_price").alias("revenue"),
            S.int_sum("quantity").alias("items_sold"),
        )
        .orderBy("date")
    )


# Pre-aggregate sales per staff id, then join the (small) staff table.
def staff_performance(staff: DataFrame, sales: DataFrame) -> DataFrame:
    per_staff = sales.filter(F.col("staff_id").isNotNull()).groupBy("staff_id").agg(
        F.count("id").alias("total_sales"),
        F.sum("total_price").alias("_rev"),
        F.count("total_price").alias("_n"),
        S.int_sum("quantity").alias("items_sold"),
    )
    active = staff.filter(F.col("status") == "active").select("id", F.col("name").alias("staff_name"))
    j = active.join(per_staff, active.id == per_staff.staff_id, "left")
    return (
        j.select(
            "id",
            "staff_name",
            F.coalesce("total_sales", F.lit(0).cast("bigint")).alias("total_sales"),
            F.col("_rev").cast("decimal(20,2)").alias("revenue"),
            (F.col("_rev").cast("double") / F.nullif(F.col("_n"), F.lit(0))).alias("average_sale"),
            "items_sold",
        )
        .orderBy(F.col("revenue").desc_nulls_last(), "id")
        .drop("id")
    )


# C6
def staff_sales_totals(staff: DataFrame, sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per staff member: totals over their sales that have an item (orphans excluded)."""
    items = inventory.select(F.col("id").alias("_iid"))
    per_staff = (
        sales.filter(F.col("staff_id").isNotNull())
        .join(items, F.col("item_id") == items._iid, "left_semi")
        .groupBy("staff_id")
        .agg(
            S.money_sum("total_price").alias("totalSales"),
            S.int_sum("quantity").alias("totalItems"),
            F.count(F.lit(1)).alias("totalTransactions"),
        )
    )
    people = staff.select("id", "name")
    return people.join(per_staff, people.id == per_staff.staff_id, "left").select(
        F.col("id").alias("staff_id"),
        "name",
        F.coalesce("totalSales", _zero_money()).alias("totalSales"),
        F.coalesce("totalItems", F.lit(0).cast("bigint")).alias("totalItems"),
        F.coalesce("totalTransactions", F.lit(0).cast("bigint")).alias("totalTransactions"),
    )


def _per_item(sales: DataFrame) -> DataFrame:
    return sales.groupBy("item_id").agg(
        S.int_sum("quantity").alias("qty"),
        S.money_sum("total_price").alias("rev"),
        F.count("id").alias("n"),
    )


# All items (LEFT JOIN), top 10 by units sold; unsold items sort last.
def top_selling_items(inventory: DataFrame, sales: DataFrame, k: int = 10) -> DataFrame:
    per_item = _per_item(sales)
    inv = inventory.select("id", F.col("name").alias("item_name"), "sku")
    return (
        inv.join(per_item, inv.id == per_item.item_id, "left")
        .select(
            "id",
            "item_name",
            "sku",
            F.col("qty").alias("total_sold"),
            F.col("rev").alias("total_revenue"),
            F.coalesce("n", F.lit(0).cast("bigint")).alias("sale_count"),
        )
        .orderBy(F.col("total_sold").desc_nulls_last(), "id")
        .limit(k)
    )


# Sold items only (INNER JOIN), top 10.
def top_items(sales: DataFrame, inventory: DataFrame, k: int = 10) -> DataFrame:
    per_item = _per_item(sales)
    inv = inventory.select("id", F.col("name").alias("item_name"))
    return (
        per_item.join(inv, per_item.item_id == inv.id)
        .select(
            "item_id",
            "item_name",
            F.col("qty").alias("total_quantity_sold"),
            F.col("rev").alias("total_revenue"),
            F.col("n").alias("number_of_sales"),
        )
        .orderBy(F.col("total_quantity_sold").desc_nulls_last(), "item_id")
        .limit(k)
    )


# Positions over an already bounded top-k (k rows, one partition).
def ranked(top: DataFrame, order_cols: list) -> DataFrame:
    from pyspark.sql import Window

    return top.withColumn("position", F.row_number().over(Window.orderBy(*order_cols)))


def top_items_ranked(sales: DataFrame, inventory: DataFrame, k: int = 10) -> DataFrame:
    top = top_items(sales, inventory, k)
    return ranked(top, [F.col("total_quantity_sold").desc_nulls_last(), F.col("item_id")])


def _year_range(year: int):
    lo = F.to_timestamp_ntz(F.lit(f"{year:04d}-01-01"))
    hi = F.to_timestamp_ntz(F.lit(f"{year + 1:04d}-01-01"))
    return (F.col("sale_date") >= lo) & (F.col("sale_date") < hi)


# Months with sales only; names in full.  The year test is written as a
# timestamp range (sargable) instead of strftime('%Y') = year.
def monthly_trend(sales: DataFrame, year: int) -> DataFrame:
    return (
        sales.filter(_year_range(year))
        .groupBy(F.month("sale_date").alias("month_num"))
        .agg(
            S.money_sum("total_price").alias("revenue"),
            F.count(F.lit(1)).alias("sales_count"),
        )
        .select(
            "month_num",
            S.month_name("month_num", "long").alias("month"),
            F.coalesce("revenue", _zero_money()).alias("revenue"),
            "sales_count",
        )
        .orderBy("month_num")
    )


# C11: all twelve months, short names, zero when no sales.
def monthly_trend_filled(sales: DataFrame, year: int) -> DataFrame:
    per_month = (
        sales.filter(_year_range(year))
        .groupBy(F.month("sale_date").alias("m"))
        .agg(S.money_sum("total_price").alias("revenue"), F.count(F.lit(1)).alias("sales_count"))
    )
    months = sales.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month_num"))
    return (
        months.join(per_month, months.month_num == per_month.m, "left")
        .select(
            "month_num",
            S.month_name("month_num", "short").alias("month"),
            F.coalesce("revenue", _zero_money()).alias("revenue"),
            F.coalesce("sales_count", F.lit(0).cast("bigint")).alias("sales_count"),
        )
        .orderBy("month_num")
    )


# sale_date >= as_of - 30 days (no upper bound), newest 30 days.
def daily_sales_30d(sales: DataFrame, as_of: str, k: int = 30) -> DataFrame:
    lo = F.to_timestamp_ntz(F.date_sub(F.lit(as_of).cast("date"), 30).cast("string"))
    return (
        sales.filter(F.col("sale_date") >= lo)
        .groupBy(S.day("sale_date").alias("date"))
        .agg(S.money_sum("total_price").alias("revenue"), F.count(F.lit(1)).alias("sales_count"))
        .orderBy(F.col("date").desc())
        .limit(k)
    )


# C13
def yearly_revenue(sales: DataFrame) -> DataFrame:
    return (
        sales.groupBy(S.year_text("sale_date").alias("year"))
        .agg(S.money_sum("total_price").alias("revenue"), F.count(F.lit(1)).alias("sales_count"))
        .orderBy("year")
    )


# C14: LEFT JOINs + `s.id IS NOT NULL` are inner joins; aggregate sales per
# item first, then per category.
def sales_by_category(categories: DataFrame, inventory: DataFrame, sales: DataFrame) -> DataFrame:
    per_item = sales.groupBy("item_id").agg(
        F.sum("total_price").alias("rev"), F.count("id").alias("n")
    )
    inv = inventory.filter(F.col("category_id").isNotNull()).select(F.col("id").alias("iid"), "category_id")
    per_cat = (
        per_item.join(inv, per_item.item_id == inv.iid)
        .groupBy("category_id")
        .agg(F.sum("rev").alias("rev"), F.sum("n").alias("n"))
    )
    cats = categories.select("id", F.col("name").alias("category"))
    return (
        per_cat.join(cats, per_cat.category_id == cats.id)
        .select(
            "id",
            "category",
            F.col("rev").cast("decimal(20,2)").alias("revenue"),
            F.col("n").cast("bigint").alias("sales_count"),
        )
        .orderBy(F.col("revenue").desc_nulls_last(), "id")
        .drop("id")
    )


# C15
def profit_margin(inventory: DataFrame, sales: DataFrame) -> DataFrame:
    per_item = sales.groupBy("item_id").agg(
        F.sum("unit_price").alias("_s"), F.count("unit_price").alias("_n")
    )
    inv = inventory.select("id", "name", "unit_price")
    avg = F.col("_s").cast("double") / F.nullif(F.col("_n"), F.lit(0))
    profit = avg - F.col("unit_price").cast("double")
    return (
        inv.join(per_item, inv.id == per_item.item_id)
        .select(
            "id",
            "name",
            "unit_price",
            avg.alias("avg_sale_price"),
            profit.alias("profit_per_unit"),
            (profit / F.nullif(F.col("unit_price").cast("double"), F.lit(0.0)) * 100).alias("profit_margin"),
        )
        .orderBy(F.col("profit_margin").desc_nulls_last(), "id")
        .drop("id")
    )


# C16
def supplier_performance(inventory: DataFrame) -> DataFrame:
    return (
        inventory.filter(F.col("supplier").isNotNull() & (F.col("supplier") != ""))
        .groupBy("supplier")
        .agg(
            F.count(F.lit(1)).alias("items_count"),
            S.int_sum("quantity").alias("total_stock"),
            S.value_sum("quantity", "unit_price").alias("total_value"),
        )
        .orderBy(F.col("total_value").desc_nulls_last(), "supplier")
    )


def _one_row_join(*frames: DataFrame) -> DataFrame:
    """Combine single-row aggregates side by side without a join.

    Each input is a global aggregate (exactly one row) with its own columns;
    the rows are unioned (other columns NULL) and collapsed by one aggregate
    that keeps each column's only value.  No cartesian product is planned.
    """
    cols = [c for f in frames for c in f.columns]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in cols])


# C17
def comprehensive(inventory: DataFrame, sales: DataFrame, staff: DataFrame) -> DataFrame:
    inv = inventory.agg(
        F.count(F.lit(1)).alias("total_items"),
        S.int_sum("quantity").alias("total_stock"),
        S.value_sum("quantity", "unit_price").alias("total_value"),
        F.count_if(F.col("quantity") <= F.col("min_quantity")).alias("low_stock_count"),
    )
    sal = sales.agg(
        F.count(F.lit(1)).alias("total_sales"),
        S.money_sum("total_price").alias("total_revenue"),
        S.mean("total_price").alias("average_sale"),
    )
    stf = staff.agg(F.count_if(F.col("status") == "active").alias("active_staff"))
    return _one_row_join(inv, sal, stf)


# C18
def budget_summary(budget: DataFrame, month_year: str | None = None) -> DataFrame:
    df = budget if month_year is None else budget.filter(F.col("month_year") == month_year)
    return df.agg(
        F.coalesce(S.money_sum("amount"), _zero_money()).alias("total_budget"),
        F.coalesce(S.money_sum("spent"), _zero_money()).alias("total_spent"),
        F.coalesce(F.sum(F.col("amount") - F.col("spent")).cast("decimal(20,2)"), _zero_money()).alias("remaining_budget"),
        F.count(F.lit(1)).alias("total_categories"),
    )


# C19
def budget_summary_status(budget: DataFrame, month_year: str | None = None) -> DataFrame:
    s = budget_summary(budget, month_year)
    total, spent = F.col("total_budget").cast("double"), F.col("total_spent").cast("double")
    pct = F.when(total > 0, F.least(spent / total * 100, F.lit(100.0))).otherwise(F.lit(0.0))
    return s.select(
        "total_budget",
        "total_spent",
        "remaining_budget",
        pct.alias("percent_used"),
        (pct > 80).alias("warn"),
        (F.col("remaining_budget") >= 0).alias("within_budget"),
    )


# C20
def dashboard_kpis(inventory: DataFrame, sales: DataFrame, staff: DataFrame) -> DataFrame:
    inv = inventory.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("quantity") <= F.col("min_quantity")).alias("low_stock_count"),
    )
    sal = sales.agg(F.coalesce(S.money_sum("total_price"), _zero_money()).alias("total_revenue"))
    stf = staff.agg(F.count_if(F.col("status") == "active").alias("active_staff"))
    return _one_row_join(inv, sal, stf)


# C21
def setup_counts(inventory: DataFrame, categories: DataFrame, staff: DataFrame, sales: DataFrame) -> DataFrame:
    """Listing sizes; sales counts only rows with an item (the listing is an inner join)."""
    items = inventory.select(F.col("id").alias("_iid"))
    listed_sales = sales.select("item_id").join(items, F.col("item_id") == items._iid, "left_semi")
    return _one_row_join(
        inventory.agg(F.count(F.lit(1)).alias("inventory")),
        categories.agg(F.count(F.lit(1)).alias("categories")),
        staff.agg(F.count(F.lit(1)).alias("staff")),
        listed_sales.agg(F.count(F.lit(1)).alias("sales")),
    )


# C22
def uncategorised_count(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count_if(F.col("category_id").isNull()).alias("uncategorised"))
