"""Row validation as data-quality rules.

A rule set is a list of (rule name, "row fails" predicate).  ``check`` adds
``failed_rules ARRAY<STRING>`` with the names of failed rules (row-local,
no shuffle); ``report`` gives failing rows and ``rule_counts`` per-rule
counts (one aggregate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a simple e-mail shape (local part, '@', domain with a dot).
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def _present_blank(c: str) -> Column:
    """Optional field given but empty."""
    return F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) == "")


def _neg(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) < 0)


def _required_nonneg(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) < 0)


def _rules(*pairs):
    return [(name, lambda p=pred: p()) for name, pred in pairs]


INVENTORY_RULES = _rules(
    ("name_required", lambda: _blank("name")),
    ("quantity_nonnegative_int", lambda: _required_nonneg("quantity")),
    ("unit_price_nonnegative", lambda: _required_nonneg("unit_price")),
)

SALES_RULES = _rules(
    ("item_id_required", lambda: F.col("item_id").isNull()),
    ("quantity_at_least_1", lambda: F.col("quantity").isNull() | (F.col("quantity") < 1)),
    ("unit_price_nonnegative", lambda: _required_nonneg("unit_price")),
    ("customer_name_required", lambda: _blank("customer_name")),
)

STAFF_RULES = _rules(
    ("name_required", lambda: _blank("name")),
    ("email_format", lambda: F.col("email").isNotNull() & ~F.col("email").rlike(EMAIL_PATTERN)),
    ("phone_not_empty", lambda: _present_blank("phone")),
    ("position_not_empty", lambda: _present_blank("position")),
    ("department_not_empty", lambda: _present_blank("department")),
    ("salary_nonnegative", lambda: _neg("salary")),
)

BUDGET_RULES = _rules(
    ("category_required", lambda: _blank("category")),
    ("amount_nonnegative", lambda: _required_nonneg("amount")),
    ("month_year_required", lambda: _blank("month_year")),
)

# The transaction kinds.
TRANSACTION_TYPES = ["expense", "income"]

TRANSACTION_RULES = _rules(
    ("type_valid", lambda: ~F.coalesce(F.col("type").isin(*TRANSACTION_TYPES), F.lit(False))),
    ("amount_nonnegative", lambda: _required_nonneg("amount")),
    ("description_required", lambda: _blank("description")),
    ("category_required", lambda: _blank("category")),
)


def check(df: DataFrame, rules) -> DataFrame:
    """Add failed_rules: the names of the rules the row fails, in rule order."""
    flags = [F.when(F.coalesce(pred(), F.lit(False)), F.lit(name)) for name, pred in rules]
    return df.withColumn("failed_rules", F.filter(F.array(*flags), lambda x: x.isNotNull()))


def report(df: DataFrame, rules, key: str = "id") -> DataFrame:
    """Failing rows: (key, failed_rules as 'a,b' text)."""
    return (
        check(df, rules)
        .filter(F.size("failed_rules") > 0)
        .select(key, F.array_join("failed_rules", ",").alias("failed_rules"))
    )


def rule_counts(df: DataFrame, rules) -> DataFrame:
    """One row per rule: (rule, failures), single aggregate pass."""
    aggs = [F.count_if(F.coalesce(pred(), F.lit(False))).alias(name) for name, pred in rules]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{name}', `{name}`" for name, _ in rules)
    return wide.selectExpr(f"stack({len(rules)}, {stack}) as (rule, failures)")
