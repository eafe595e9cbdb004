"""Validation of raw request bodies (F1-F5): JSON as it came, before anything is typed.

A body is parsed once into a VARIANT.  Every field then has a verdict beside its typed value:
``given`` (there at all; JSON null counts as given), ``text`` (the value as text, numbers as
they print), ``value`` (typed, NULL where it does not convert) and ``ok``.  So 'abc', 1.5 or ''
for a whole number is reported by its rule instead of becoming NULL or 1.  All of it is row-local
and stays in Spark's own functions.

A body that is no JSON object has no fields: every required one fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import EMAIL_PATTERN, TRANSACTION_TYPES

# What counts as a whole number and as a number (text form).
INT_TEXT = r"^[-+]?[0-9]+$"
FLOAT_TEXT = r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$"


@dataclass(frozen=True)
class Rule:
    """One field's rule; ``optional`` fields may be absent (a JSON null is not absent)."""

    name: str
    field: str
    kind: str  # int, float, text, email or one of
    least: int | None = None
    optional: bool = False
    among: tuple[str, ...] = ()


RULES = {
    "inventory": (
        Rule("name_required", "name", "text"),
        Rule("quantity_nonnegative_int", "quantity", "int", 0),
        Rule("unit_price_nonnegative", "unit_price", "float", 0),
        Rule("category_id_int", "category_id", "int", optional=True),
    ),
    "sales": (
        Rule("item_id_int", "item_id", "int"),
        Rule("quantity_at_least_1", "quantity", "int", 1),
        Rule("unit_price_nonnegative", "unit_price", "float", 0),
        Rule("customer_name_required", "customer_name", "text"),
        Rule("staff_id_int", "staff_id", "int", optional=True),
    ),
    "staff": (
        Rule("name_required", "name", "text"),
        Rule("email_format", "email", "email", optional=True),
        Rule("phone_not_empty", "phone", "text", optional=True),
        Rule("position_not_empty", "position", "text", optional=True),
        Rule("department_not_empty", "department", "text", optional=True),
        Rule("salary_nonnegative", "salary", "float", 0, optional=True),
    ),
    "budget": (
        Rule("category_required", "category", "text"),
        Rule("amount_nonnegative", "amount", "float", 0),
        Rule("month_year_required", "month_year", "text"),
    ),
    "transactions": (
        Rule("type_valid", "type", "one of", among=tuple(TRANSACTION_TYPES)),
        Rule("amount_nonnegative", "amount", "float", 0),
        Rule("description_required", "description", "text"),
        Rule("category_required", "category", "text"),
    ),
}


def _text(cell: Column, plain: Column) -> Column:
    """The field as text; a number prints without closing zeros."""
    number = F.schema_of_variant(cell).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.coalesce(F.when(plain.contains(".") & number, F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain), F.lit(""))


def _value(rule: Rule, text: Column) -> Column:
    """The typed value of the rule's field, NULL where its text does not convert."""
    if rule.kind == "int":
        return F.when(text.rlike(INT_TEXT), text.try_cast("bigint"))
    if rule.kind == "float":
        return F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))
    if rule.kind == "email":
        return F.when(text.rlike(EMAIL_PATTERN), text)
    if rule.kind == "one of":
        return F.when(text.isin(*rule.among), text)
    return F.when(F.trim(text) != "", text)


def _verdict(rule: Rule, cell: Column, text: Column, value: Column) -> Column:
    """struct(given, text, value, ok) of the rule's field."""
    given = cell.isNotNull()
    ok = value.isNotNull() if rule.least is None else F.coalesce(value >= rule.least, F.lit(False))
    if rule.optional:
        ok = ok | ~given
    return F.struct(given.alias("given"), text.alias("text"), value.alias("value"), ok.alias("ok"))


def _fields(requests: DataFrame, kind: str, json: str) -> DataFrame:
    """requests with one struct per field of the kind's rules; every step is a column of its own and runs once a row."""
    rules = RULES[kind]
    kept = [F.col(c) for c in requests.columns]
    body = F.col("_body")
    out = requests.select(*kept, F.try_parse_json(F.col(json)).alias("_body"))
    cells = [F.try_variant_get(body, f"$.{r.field}", "variant").alias(f"_cell_{r.field}") for r in rules]
    plain = [F.try_variant_get(body, f"$.{r.field}", "string").alias(f"_plain_{r.field}") for r in rules]
    out = out.select(*kept, *cells, *plain)
    cells = [F.col(f"_cell_{r.field}") for r in rules]
    out = out.select(*kept, *cells, *[_text(c, F.col(f"_plain_{r.field}")).alias(f"_text_{r.field}") for r, c in zip(rules, cells)])
    texts = [F.col(f"_text_{r.field}") for r in rules]
    out = out.select(*kept, *cells, *texts, *[_value(r, t).alias(f"_value_{r.field}") for r, t in zip(rules, texts)])
    return out.select(*kept, *[_verdict(r, c, t, F.col(f"_value_{r.field}")).alias(r.field) for r, c, t in zip(rules, cells, texts)])


def checked(requests: DataFrame, kind: str, json: str = "json") -> DataFrame:
    """requests with one struct per field of the kind's rules, and ``failed_rules`` in rule order."""
    failed = F.array_compact(F.array(*[F.when(~F.col(f"{r.field}.ok"), F.lit(r.name)) for r in RULES[kind]]))
    # Generated (one row each), so that a filter on it stays above: moved below, it would parse the body once for every use of a field.
    return _fields(requests, kind, json).select("*", F.explode(F.array(failed)).alias("failed_rules"))


def report(requests: DataFrame, kind: str, key: str = "seq") -> DataFrame:
    """(key, failed_rules as 'a,b' text) of the bodies that fail."""
    bad = checked(requests, kind).filter(F.size("failed_rules") > 0)
    return bad.select(key, F.array_join("failed_rules", ",").alias("failed_rules"))


def rule_counts(requests: DataFrame, kind: str) -> DataFrame:
    """(rule, failures) for every rule of the kind, in one aggregate."""
    found = _fields(requests, kind, "json")
    wide = found.agg(*[F.count_if(~F.col(f"{r.field}.ok")).alias(r.name) for r in RULES[kind]])
    stack = ", ".join(f"'{r.name}', `{r.name}`" for r in RULES[kind])
    return wide.selectExpr(f"stack({len(RULES[kind])}, {stack}) as (rule, failures)")
