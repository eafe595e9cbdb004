"""Raw request bodies of the fixtures: what every field holds, as SQL that both engines run."""

from __future__ import annotations


def _some(key: str, by: int, bad: list[str | None], good: str) -> str:
    """SQL of a JSON token: one of ``bad`` for the first remainders of key % by (None: the field is absent), else ``good``."""
    cases = " ".join(f"WHEN {i} THEN {'CAST(NULL AS STRING)' if b is None else chr(39) + b + chr(39)}" for i, b in enumerate(bad))
    return f"CASE {key} % {by} {cases} ELSE {good} END"


def _quoted(column: str) -> str:
    return f"'\"' || {column} || '\"'"


# Raw request bodies, one per row of (table, key): the SQL of every field's JSON token (both engines run it).
RAW_BODIES: dict[str, tuple[str, str, dict[str, str]]] = {
    "inventory": ("part", "p_partkey", {
        "name": _some("p_partkey", 11, ['""', "null", '" "', None, "7"], _quoted("p_name")),
        "quantity": _some("p_partkey", 13, ['"abc"', "1.5", '""', "null", None, "-3", '"12"', '"+4"', "true", "7.0"], "CAST(p_size AS STRING)"),
        "unit_price": _some("p_partkey", 7, ['"free"', '"1e2"', "-0.5", '".5"', None], "CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS STRING)"),
        "category_id": _some("p_partkey", 5, [None, "null", '"x"'], "CAST(p_partkey % 9 AS STRING)"),
    }),
    "sales": ("sales", "id", {
        "item_id": _some("id", 11, ['"abc"', '""', "null", '"17"', None, "2.5"], "CAST(item_id AS STRING)"),
        "quantity": _some("id", 13, ["0", "1.5", '"2"', "-3", '" "', None, "99999999999999999999"], "CAST(quantity AS STRING)"),
        "unit_price": _some("id", 17, ['"free"', "-1", '"."', '"+.5"', "null", '"1e-2"'], "CAST(unit_price AS STRING)"),
        "customer_name": _some("id", 19, ['""', "null", None, '"  "', "5"], _quoted("customer_name")),
        "staff_id": _some("id", 7, [None, "null", '"x"', '"3"'], "CAST(id % 50 AS STRING)"),
    }),
    "staff": ("supplier", "s_suppkey", {
        "name": _some("s_suppkey", 9, ['""', None, "null"], _quoted("s_name")),
        "email": _some("s_suppkey", 8, [None, "null", '"no at"', '"a@b"', '"a@b.c"'], '\'"u\' || CAST(s_suppkey AS STRING) || \'@x.io"\''),
        "phone": _some("s_suppkey", 5, [None, '""', "null"], '\'"555"\''),
        "position": _some("s_suppkey", 6, [None, '" "'], '\'"Clerk"\''),
        "department": _some("s_suppkey", 7, [None, '""', "12"], '\'"HQ"\''),
        "salary": _some("s_suppkey", 10, [None, '"lots"', "-1", '""', '"12.5"'], "CAST(CAST(s_acctbal AS DECIMAL(10,2)) AS STRING)"),
    }),
    "budget": ("budget", "id", {
        "category": _some("id", 5, ['""', None, "null"], _quoted("category")),
        "amount": _some("id", 7, ['"x"', "-5", None, '"7"'], "CAST(amount AS STRING)"),
        "month_year": _some("id", 3, [None, '" "'], _quoted("month_year")),
    }),
    "transactions": ("transactions", "id", {
        "type": _some("id", 7, [None, '"refund"', '"Expense"', "null"], _quoted("type")),
        "amount": _some("id", 11, ['"x"', "-5", None, "null", '"7"'], "CAST(amount AS STRING)"),
        "description": _some("id", 13, ['""', None], _quoted("description")),
        "category": _some("id", 17, ["null", '" "', "3"], _quoted("category")),
    }),
}
