"""Explicit schemas of the business tables (stock, sales, staff, budgets).

Timestamps are zone-less (TIMESTAMP_NTZ), as stored in the source Parquet.
Money is DECIMAL(10,2); quantities INT; keys BIGINT.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
# Result types of sums, fixed so every engine reports the same type.
MONEY_SUM = T.DecimalType(20, 2)  # SUM(money)
VALUE_SUM = T.DecimalType(24, 2)  # SUM(quantity * money)
TS = T.TimestampNTZType()


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


CATEGORIES = T.StructType([
    _f("id", T.LongType()),
    _f("name", T.StringType()),
    _f("description", T.StringType()),
    _f("created_at", TS),
])

INVENTORY = T.StructType([
    _f("id", T.LongType()),
    _f("name", T.StringType()),
    _f("description", T.StringType()),
    _f("category_id", T.LongType()),
    _f("sku", T.StringType()),
    _f("quantity", T.IntegerType()),
    _f("min_quantity", T.IntegerType()),
    _f("unit_price", MONEY),
    _f("supplier", T.StringType()),
    _f("location", T.StringType()),
    _f("created_at", TS),
    _f("updated_at", TS),
])

SALES = T.StructType([
    _f("id", T.LongType()),
    _f("item_id", T.LongType()),
    _f("quantity", T.IntegerType()),
    _f("unit_price", MONEY),
    _f("total_price", MONEY),
    _f("customer_name", T.StringType()),
    _f("customer_phone", T.StringType()),
    _f("staff_id", T.LongType()),
    _f("sale_date", TS),
    _f("payment_method", T.StringType()),
    _f("notes", T.StringType()),
])

STAFF = T.StructType([
    _f("id", T.LongType()),
    _f("name", T.StringType()),
    _f("email", T.StringType()),
    _f("phone", T.StringType()),
    _f("position", T.StringType()),
    _f("department", T.StringType()),
    _f("hire_date", T.DateType()),
    _f("salary", MONEY),
    _f("status", T.StringType()),
    _f("created_at", TS),
])

# Budget "form A": one text month column 'YYYY-MM'.
BUDGET = T.StructType([
    _f("id", T.LongType()),
    _f("category", T.StringType()),
    _f("amount", MONEY),
    _f("spent", MONEY),
    _f("month_year", T.StringType()),
    _f("created_at", TS),
])

# Budget "form B": separate month and year integers.
BUDGET_FORM_B = T.StructType([
    _f("id", T.LongType()),
    _f("category", T.StringType()),
    _f("allocated_amount", MONEY),
    _f("spent_amount", MONEY),
    _f("month", T.IntegerType()),
    _f("year", T.IntegerType()),
    _f("created_at", TS),
])

TRANSACTIONS = T.StructType([
    _f("id", T.LongType()),
    _f("type", T.StringType()),
    _f("amount", MONEY),
    _f("description", T.StringType()),
    _f("category", T.StringType()),
    _f("date", TS),
    _f("staff_id", T.LongType()),
])

# Tables covered by backup, restore and row counts, in this order.
BACKUP_TABLES = ("categories", "inventory", "sales", "staff", "budget")

TABLE_SCHEMAS = {
    "categories": CATEGORIES,
    "inventory": INVENTORY,
    "sales": SALES,
    "staff": STAFF,
    "budget": BUDGET,
    "transactions": TRANSACTIONS,
}
