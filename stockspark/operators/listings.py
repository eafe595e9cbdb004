"""Look-ups, filters and joined listings.

Every sort ends with a unique key so results are deterministic.  Filters are
applied before joins so they reach the Parquet scan; dimension joins are left
to Spark's size-checked broadcast (``autoBroadcastJoinThreshold``) and AQE,
which fall back to a shuffle join when a side turns out large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def _cat_names(categories: DataFrame) -> DataFrame:
    return categories.select(F.col("id").alias("_cid"), F.col("name").alias("category_name"))


def with_category(inventory: DataFrame, categories: DataFrame) -> DataFrame:
    """inventory.* + category_name (LEFT JOIN categories)."""
    cats = _cat_names(categories)
    return inventory.join(cats, inventory.category_id == cats._cid, "left").drop("_cid")


# B1
def categories_list(categories: DataFrame) -> DataFrame:
    return categories.orderBy("name", "id")


# B2
def inventory_list(inventory: DataFrame, categories: DataFrame) -> DataFrame:
    return with_category(inventory, categories).orderBy("name", "id")


# B3
def inventory_item(inventory: DataFrame, categories: DataFrame, item_id: int) -> DataFrame:
    return with_category(inventory.filter(F.col("id") == item_id), categories)


# B4
def category_by_id(categories: DataFrame, category_id: int) -> DataFrame:
    return categories.filter(F.col("id") == category_id)


# B5
def inventory_search(inventory: DataFrame, categories: DataFrame, term: str) -> DataFrame:
    pat = S.like_pattern(term)
    hit = F.col("name").ilike(pat) | F.col("description").ilike(pat) | F.col("sku").ilike(pat)
    return with_category(inventory.filter(F.coalesce(hit, F.lit(False))), categories).orderBy("name", "id")


# B6
def inventory_search_contains(inventory: DataFrame, categories: DataFrame, term: str) -> DataFrame:
    """UI search: plain substring, case-insensitive; empty term keeps all."""
    df = with_category(inventory, categories)
    if term:
        df = df.filter(S.contains_ci("name", term) | S.contains_ci("sku", term) | S.contains_ci("description", term))
    return df.orderBy("name", "id")


# B7
def inventory_by_category_filter(inventory: DataFrame, categories: DataFrame, category_id: int | None) -> DataFrame:
    df = inventory if category_id is None else inventory.filter(F.col("category_id") == category_id)
    return with_category(df, categories).orderBy("name", "id")


def _low(df: DataFrame) -> DataFrame:
    return df.filter(F.col("quantity") <= F.col("min_quantity"))


# B8
def low_stock_items(inventory: DataFrame, categories: DataFrame) -> DataFrame:
    return with_category(_low(inventory), categories).orderBy("quantity", "id")


# B9
def low_stock_alert(inventory: DataFrame, categories: DataFrame) -> DataFrame:
    return (
        with_category(_low(inventory), categories)
        .select("name", "quantity", "min_quantity", "category_name", "id")
        .orderBy("quantity", "id")
        .drop("id")
    )


def _deficit(inventory: DataFrame, categories: DataFrame) -> DataFrame:
    df = _low(inventory).filter(F.col("min_quantity") > 0)
    return with_category(df, categories).select("id", "name", "sku", "quantity", "min_quantity", "category_name")


# B10 (top-k: Spark plans ORDER BY + LIMIT as TakeOrderedAndProject)
def low_stock_alerts_top10(inventory: DataFrame, categories: DataFrame, k: int = 10) -> DataFrame:
    return _deficit(inventory, categories).orderBy(F.col("quantity") - F.col("min_quantity"), "id").limit(k)


# B11
def low_stock_deficit(inventory: DataFrame, categories: DataFrame) -> DataFrame:
    return _deficit(inventory, categories).orderBy(F.col("quantity") - F.col("min_quantity"), "id")


def sales_joined(sales: DataFrame, inventory: DataFrame, staff: DataFrame) -> DataFrame:
    """sales.* + item_name (INNER: orphan sales drop) + staff_name (LEFT)."""
    items = inventory.select(F.col("id").alias("_iid"), F.col("name").alias("item_name"))
    people = staff.select(F.col("id").alias("_sid"), F.col("name").alias("staff_name"))
    return (
        sales.join(items, sales.item_id == items._iid, "inner")
        # sales without staff get keys of their own, which no staff row has, so they are spread and not one hot key
        .join(people, F.coalesce(F.col("staff_id"), -F.col("id") - 1) == people._sid, "left")
        .drop("_iid", "_sid")
    )


def _newest_first(df: DataFrame, ts: str = "sale_date") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col("id").desc())


# B12
def sales_list(sales: DataFrame, inventory: DataFrame, staff: DataFrame) -> DataFrame:
    return _newest_first(sales_joined(sales, inventory, staff))


# B13
def sale_by_id(sales: DataFrame, inventory: DataFrame, staff: DataFrame, sale_id: int) -> DataFrame:
    return sales_joined(sales.filter(F.col("id") == sale_id), inventory, staff)


# DATE(sale_date) BETWEEN start AND end -> the whole end day counts.
# Written as a half-open timestamp range so Parquet statistics can prune.
def sales_date_range(sales: DataFrame, inventory: DataFrame, staff: DataFrame, start: str, end: str) -> DataFrame:
    lo = F.to_timestamp_ntz(F.lit(start))
    hi = F.to_timestamp_ntz(F.date_add(F.lit(end).cast("date"), 1).cast("string"))
    df = sales.filter((F.col("sale_date") >= lo) & (F.col("sale_date") < hi))
    return _newest_first(sales_joined(df, inventory, staff))


# B15
def sales_by_payment(sales: DataFrame, inventory: DataFrame, staff: DataFrame, method: str) -> DataFrame:
    return _newest_first(sales_joined(sales.filter(F.col("payment_method") == method), inventory, staff))


# B16
def customer_history(sales: DataFrame, inventory: DataFrame, name: str) -> DataFrame:
    items = inventory.select(F.col("id").alias("_iid"), F.col("name").alias("item_name"))
    df = sales.filter(F.col("customer_name").ilike(S.like_pattern(name)))
    return (
        df.join(items, df.item_id == items._iid)
        .orderBy(F.col("sale_date").desc(), F.col("id").desc())
        .select("sale_date", "item_name", "quantity", "total_price", "payment_method")
    )


# B17-B20
def staff_list(staff: DataFrame) -> DataFrame:
    return staff.orderBy("name", "id")


def staff_active(staff: DataFrame) -> DataFrame:
    return staff.filter(F.col("status") == "active").orderBy("name", "id")


def staff_by_department(staff: DataFrame, department: str) -> DataFrame:
    return staff.filter(F.col("department") == department).orderBy("name", "id")


def staff_by_id(staff: DataFrame, staff_id: int) -> DataFrame:
    return staff.filter(F.col("id") == staff_id)


# B21
def staff_sales_detail(sales: DataFrame, inventory: DataFrame, staff_id: int) -> DataFrame:
    items = inventory.select(F.col("id").alias("_iid"), F.col("name").alias("item_name"))
    df = sales.filter(F.col("staff_id") == staff_id)
    return (
        df.join(items, df.item_id == items._iid)
        .orderBy(F.col("sale_date").desc(), F.col("id").desc())
        .select("id", "sale_date", "total_price", "item_name", "quantity", "customer_name")
    )


# B22-B25
def budgets_list(budget: DataFrame) -> DataFrame:
    return budget.orderBy(F.col("month_year").desc(), "category", "id")


def budget_by_id(budget: DataFrame, budget_id: int) -> DataFrame:
    return budget.filter(F.col("id") == budget_id)


def budgets_by_category(budget: DataFrame, category: str) -> DataFrame:
    return budget.filter(F.col("category") == category).orderBy(F.col("month_year").desc(), "id")


def budgets_by_month(budget: DataFrame, month_year: str) -> DataFrame:
    return budget.filter(F.col("month_year") == month_year).orderBy("category", "id")


# B26-B28
def transactions_joined(transactions: DataFrame, staff: DataFrame) -> DataFrame:
    people = staff.select(F.col("id").alias("_sid"), F.col("name").alias("staff_name"))
    return transactions.join(people, transactions.staff_id == people._sid, "left").drop("_sid")


def transactions_list(transactions: DataFrame, staff: DataFrame) -> DataFrame:
    return _newest_first(transactions_joined(transactions, staff), "date")


def transactions_by_type(transactions: DataFrame, staff: DataFrame, kind: str) -> DataFrame:
    return _newest_first(transactions_joined(transactions.filter(F.col("type") == kind), staff), "date")


def transactions_by_category(transactions: DataFrame, staff: DataFrame, category: str) -> DataFrame:
    return _newest_first(transactions_joined(transactions.filter(F.col("category") == category), staff), "date")


# B29
def budget_vs_actual(budget: DataFrame, category: str, as_of: str) -> DataFrame:
    month = S.month_year(F.lit(as_of).cast("date"))
    return budget.filter((F.col("category") == category) & (F.col("month_year") == month)).select(
        F.col("amount").alias("budget_amount"),
        F.col("spent").alias("actual_spent"),
        (F.col("amount") - F.col("spent")).alias("remaining"),
        S.safe_ratio_pct("spent", "amount").alias("percentage_used"),
    )


# B30
def recent_sales_top5(sales: DataFrame, inventory: DataFrame, staff: DataFrame, k: int = 5) -> DataFrame:
    return _newest_first(sales_joined(sales, inventory, staff)).limit(k)


# B31
def items_with_category_audit(inventory: DataFrame, categories: DataFrame) -> DataFrame:
    return (
        with_category(inventory.select("id", "name", "category_id"), categories)
        .select("id", "name", "category_id", S.or_na("category_name").alias("current_category"))
        .orderBy("name", "id")
    )


# B32
def sales_category_audit(sales: DataFrame, inventory: DataFrame, categories: DataFrame, k: int = 10) -> DataFrame:
    items = inventory.select(F.col("id").alias("_iid"), F.col("name").alias("item_name"), "category_id")
    cats = _cat_names(categories)
    return (
        sales.select("id", "item_id")
        .join(items, F.col("item_id") == items._iid)
        .join(cats, F.col("category_id") == cats._cid, "left")
        .select("id", "item_id", "item_name", "category_name")
        .orderBy("id")
        .limit(k)
    )


# B33
def items_by_category_inner(inventory: DataFrame, categories: DataFrame) -> DataFrame:
    cats = _cat_names(categories)
    return (
        inventory.join(cats, inventory.category_id == cats._cid, "inner")
        .select("id", "name", "category_name")
        .orderBy("category_name", "name", "id")
        .drop("id")
    )


# B34
def stock_status(inventory: DataFrame, categories: DataFrame) -> DataFrame:
    q = F.col("quantity")
    return with_category(inventory, categories).select(
        "id",
        "name",
        S.or_na("sku").alias("sku"),
        S.or_na("category_name").alias("category_name"),
        q.alias("quantity"),
        (q <= F.col("min_quantity")).alias("is_low"),
        (q * F.coalesce(F.col("unit_price"), F.lit(0).cast("decimal(10,2)"))).cast("decimal(24,2)").alias("line_value"),
        F.when(q <= 0, F.lit("out of stock")).otherwise(F.concat(q.cast("string"), F.lit(" in stock"))).alias(
            "availability"
        ),
    )


# B35
def budget_status(budget: DataFrame) -> DataFrame:
    remaining = F.col("amount") - F.col("spent")
    return budget.select(
        "id",
        "category",
        "month_year",
        "amount",
        "spent",
        remaining.alias("remaining"),
        S.safe_ratio_pct("spent", "amount").alias("percentage"),
        (remaining < 0).alias("is_over"),
    )


# Sales listing with display amounts
def sales_display(sales: DataFrame, inventory: DataFrame, staff: DataFrame) -> DataFrame:
    return sales_joined(sales, inventory, staff).select(
        "id",
        "item_name",
        "staff_name",
        "sale_date",
        S.display_money("unit_price").alias("unit_price_display"),
        S.display_money("total_price").alias("total_price_display"),
    )
