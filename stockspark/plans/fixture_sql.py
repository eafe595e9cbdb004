"""The fixture mapping of ``sources.fixtures`` written as DuckDB CTEs.

Oracle queries are ``WITH <these CTEs> <query>``, run by DuckDB over the same
driver Parquet views.  DuckDB inlines CTEs, so unused ones cost nothing.
"""

from __future__ import annotations

CTES = {
    "categories": """
categories AS (
  SELECT CAST(1 + dense_rank() OVER (ORDER BY p_type) AS BIGINT) AS id,
         p_type AS name, CAST(NULL AS VARCHAR) AS description,
         CAST(NULL AS TIMESTAMP) AS created_at
  FROM (SELECT DISTINCT p_type FROM part) t
  UNION ALL SELECT 5001, 'Pumps', NULL, NULL
  UNION ALL SELECT 5002, 'Valves', NULL, NULL
)""",
    "categories_dirty": """
categories_dirty AS (
  SELECT * FROM categories
  UNION ALL
  SELECT id + 10000, '  ' || upper(name), description, created_at
  FROM categories WHERE id % 2 = 0
)""",
    "inventory": """
inventory AS (
  SELECT p.p_partkey AS id,
         p.p_name || ' ' || CAST(p.p_partkey AS VARCHAR) AS name,
         p.p_brand || ' ' || p.p_type AS description,
         CASE WHEN p.p_partkey % 23 = 0 THEN NULL ELSE c.id END AS category_id,
         'SKU-' || CAST(p.p_partkey AS VARCHAR) AS sku,
         CAST((p.p_partkey * 37) % 101 AS INTEGER) AS quantity,
         CAST(CASE WHEN p.p_partkey % 19 = 0 THEN NULL
                   WHEN p.p_partkey % 7 = 0 THEN 0
                   ELSE p.p_size END AS INTEGER) AS min_quantity,
         CAST(CASE WHEN p.p_partkey % 41 = 0 THEN 0.0 ELSE p.p_retailprice END AS DECIMAL(10,2)) AS unit_price,
         CASE WHEN p.p_partkey % 13 = 0 THEN NULL
              WHEN p.p_partkey % 13 = 1 THEN ''
              ELSE p.p_brand END AS supplier,
         'Aisle ' || CAST(p.p_partkey % 12 AS VARCHAR) AS location,
         CAST(NULL AS TIMESTAMP) AS created_at,
         CAST(NULL AS TIMESTAMP) AS updated_at
  FROM part p JOIN categories c ON c.name = p.p_type
)""",
    "staff": """
staff AS (
  SELECT s.s_suppkey AS id, s.s_name AS name,
         CASE WHEN s.s_suppkey % 9 = 4 THEN 'not-an-email'
              ELSE 'u' || CAST(s.s_suppkey AS VARCHAR) || '@example.com' END AS email,
         CAST(NULL AS VARCHAR) AS phone,
         CASE s.s_suppkey % 3 WHEN 0 THEN 'Clerk' WHEN 1 THEN 'Manager' ELSE 'Cashier' END AS position,
         n.n_name AS department,
         CAST(DATE '2015-01-01' + CAST(s.s_suppkey % 3650 AS INTEGER) AS DATE) AS hire_date,
         CAST(s.s_acctbal AS DECIMAL(10,2)) AS salary,
         CASE s.s_suppkey % 10 WHEN 3 THEN 'inactive' WHEN 7 THEN 'terminated' ELSE 'active' END AS status,
         CAST(NULL AS TIMESTAMP) AS created_at
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
)""",
    "sales": """
sales AS (
  SELECT row_number() OVER (ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity,
                            l.l_extendedprice, l.l_shipdate, l.l_returnflag) AS id,
         CASE WHEN l.l_partkey % 29 = 0 THEN -l.l_partkey ELSE l.l_partkey END AS item_id,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         CAST(floor(round(l.l_extendedprice * 100) / l.l_quantity) / 100 AS DECIMAL(10,2)) AS unit_price,
         CAST(l.l_extendedprice AS DECIMAL(10,2)) AS total_price,
         cu.c_name AS customer_name,
         CAST(NULL AS VARCHAR) AS customer_phone,
         CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE l.l_suppkey END AS staff_id,
         l.l_shipdate + to_seconds((l.l_orderkey * 7919 + l.l_linenumber * 3571) % 86400) AS sale_date,
         o.o_orderpriority AS payment_method,
         CASE WHEN l.l_returnflag = 'R' THEN 'returned' END AS notes
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer cu ON o.o_custkey = cu.c_custkey
)""",
    "budget": """
budget AS (
  SELECT m * 1000 + c.id AS id, c.name AS category,
         CAST(CASE WHEN c.id = 4 THEN 0 ELSE c.id * m * 1000 END AS DECIMAL(10,2)) AS amount,
         CAST(c.id * 10 AS DECIMAL(10,2)) AS spent,
         '2024-' || lpad(CAST(m AS VARCHAR), 2, '0') AS month_year,
         CAST(NULL AS TIMESTAMP) AS created_at
  FROM categories c, (VALUES (1), (2), (3)) mm(m)
)""",
    "transactions": """
transactions AS (
  SELECT e.event_id AS id,
         CASE WHEN e.event_type IN ('purchase', 'signup') THEN 'income' ELSE 'expense' END AS type,
         CAST(e.value AS DECIMAL(10,2)) AS amount,
         e.event_type AS description,
         c.name AS category,
         e.ts AS date,
         e.user_id AS staff_id
  FROM events e JOIN categories c ON c.id = 2 + e.user_id % 6
)""",
    "stock_ops": """
stock_ops AS (
  SELECT event_id AS seq, user_id AS item_id,
         CASE WHEN event_type = 'purchase' THEN 'subtract'
              WHEN event_type = 'error' THEN 'set'
              WHEN event_type = 'signup' THEN 'signup' ELSE 'add' END AS operation,
         CAST(floor(value) AS INTEGER) AS quantity
  FROM events
)""",
    "sale_requests": """
sale_requests AS (
  SELECT id AS request_id, item_id, quantity, unit_price, customer_name, customer_phone,
         staff_id, sale_date AS requested_at, payment_method, notes
  FROM sales
)""",
}

ORDER = [
    "categories",
    "categories_dirty",
    "inventory",
    "staff",
    "sales",
    "budget",
    "transactions",
    "stock_ops",
    "sale_requests",
]

REQUEST_CTES = {
    "category_requests": """
category_requests AS (
  SELECT p_partkey AS seq,
         CASE WHEN p_partkey % 4 = 0 THEN p_type
              WHEN p_partkey % 4 = 1 THEN p_brand
              WHEN p_partkey % 4 = 2 THEN '  ' || lower(p_brand) || ' '
              WHEN p_partkey % 8 = 3 THEN 'x'
              ELSE p_brand || ' & Co' END AS name,
         p_name AS description
  FROM part
)""",
    "category_update_requests": """
category_update_requests AS (
  SELECT id AS seq, id,
         CASE WHEN id % 2 = 0 THEN lower(trim(name)) || ' line' ELSE 'pumps' END AS name,
         'updated' AS description
  FROM categories_dirty
  UNION ALL SELECT id + 1 + 1000000000000000000, id + 1, name, 'shifted' FROM categories
  UNION ALL SELECT id + 2000000000000000000, id, ' Common ', 'common' FROM categories WHERE id % 3 = 0
)""",
    "category_delete_requests": """
category_delete_requests AS (
  SELECT id AS seq, id FROM categories_dirty
  UNION ALL SELECT id + 1000000000000000000, id FROM categories_dirty WHERE id % 2 = 1
)""",
    "inventory_insert_requests": """
inventory_insert_requests AS (
  SELECT p_partkey AS seq,
         CASE WHEN p_partkey % 29 = 0 THEN 'New ' || p_name || ' ' || CAST(p_partkey AS VARCHAR)
              ELSE upper(p_name || ' ' || CAST(p_partkey AS VARCHAR)) END AS name,
         p_brand AS description, CAST(NULL AS BIGINT) AS category_id,
         'NEW-' || CAST(p_partkey AS VARCHAR) AS sku,
         CAST(CASE WHEN p_partkey % 31 = 0 THEN -1 ELSE p_partkey % 50 END AS INTEGER) AS quantity,
         5 AS min_quantity, CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price,
         p_brand AS supplier, 'Dock' AS location
  FROM part
)""",
    "inventory_update_requests": """
inventory_update_requests AS (
  SELECT p.p_partkey AS seq, CASE WHEN p.p_partkey % 29 = 0 THEN -p.p_partkey ELSE p.p_partkey END AS id,
         CASE p.p_partkey % 4 WHEN 0 THEN ['quantity'] WHEN 1 THEN ['name']
              WHEN 2 THEN ['unit_price', 'supplier'] ELSE CAST([] AS VARCHAR[]) END AS fields,
         CASE WHEN p.p_partkey % 8 = 1 THEN upper(p.p_name || ' ' || CAST(p.p_partkey AS VARCHAR))
              ELSE concat_ws(' ', q.p_name, CAST(q.p_partkey AS VARCHAR)) END AS new_name,
         CAST(p.p_partkey % 50 AS INTEGER) AS new_quantity,
         CAST(CAST(p.p_retailprice AS DECIMAL(10,2)) + 1 AS DECIMAL(10,2)) AS new_unit_price,
         'Acme' AS new_supplier,
         CAST(NULL AS VARCHAR) AS new_description, CAST(NULL AS BIGINT) AS new_category_id,
         CAST(NULL AS VARCHAR) AS new_sku, CAST(NULL AS INTEGER) AS new_min_quantity,
         CAST(NULL AS VARCHAR) AS new_location
  FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey - 1
  UNION ALL
  SELECT p_partkey + 1000000000000000000, p_partkey,
         CASE p_partkey % 2 WHEN 0 THEN ['quantity'] ELSE ['supplier'] END,
         NULL, 11, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM part WHERE p_partkey % 3 = 0
  UNION ALL
  SELECT p_partkey + 2000000000000000000, p_partkey, ['name'], 'Renamed ' || CAST(p_partkey // 12 AS VARCHAR),
         NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM part WHERE p_partkey % 6 = 0
  UNION ALL
  SELECT p_partkey + 3000000000000000000, p_partkey - 3, ['name', 'supplier'], ' ' || lower(p_name || ' ' || CAST(p_partkey AS VARCHAR)),
         NULL, NULL, 'Acme', NULL, NULL, NULL, NULL, NULL
  FROM part WHERE p_partkey % 6 = 0
)""",
    "rows_delete_requests": """
rows_delete_requests AS (
  SELECT s_suppkey AS seq, s_suppkey AS id FROM supplier
  UNION ALL SELECT s_suppkey + 1000000000000000000, s_suppkey FROM supplier WHERE s_suppkey % 4 = 0
)""",
    "sale_update_requests": """
sale_update_requests AS (
  SELECT id AS seq, CASE WHEN id % 31 = 5 THEN -id ELSE id END AS id,
         CASE WHEN id % 13 = 0 THEN CAST([] AS VARCHAR[]) WHEN id % 4 = 0 THEN ['quantity'] WHEN id % 4 = 1 THEN ['unit_price']
              WHEN id % 4 = 2 THEN ['customer_name'] ELSE ['quantity', 'unit_price'] END AS fields,
         CAST(CASE WHEN id % 44 = 0 THEN 0 WHEN id % 4 = 0 THEN quantity + 1 ELSE 2 END AS INTEGER) AS new_quantity,
         CAST(CASE WHEN id % 4 = 1 THEN 0 ELSE 9.99 END AS DECIMAL(10,2)) AS new_unit_price,
         'Walk-in' AS new_customer_name, CAST(NULL AS VARCHAR) AS new_notes
  FROM sales
  UNION ALL
  SELECT id + 1000000000000000000, id,
         CASE id % 2 WHEN 0 THEN ['notes', 'unit_price'] ELSE ['quantity'] END,
         7, CAST(CASE WHEN id % 5 = 0 THEN 0 ELSE 3.5 END AS DECIMAL(10,2)), 'x', CAST(NULL AS VARCHAR)
  FROM sales WHERE id % 3 = 0
)""",
    "sale_delete_requests": """
sale_delete_requests AS (
  SELECT id AS seq, id FROM sales WHERE notes = 'returned'
  UNION ALL SELECT id + 1000000000000000000, id FROM sales WHERE notes = 'returned' AND id % 5 = 0
  UNION ALL SELECT -id, -id FROM sales WHERE notes = 'returned' AND id % 7 = 0
)""",
    "staff_insert_requests": """
staff_insert_requests AS (
  SELECT c_custkey AS seq, c_name AS name,
         CASE WHEN c_custkey % 50 = 1 THEN 'u1@example.com'
              WHEN c_custkey % 50 = 2 THEN 'bad-email'
              ELSE 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
         CASE WHEN c_custkey % 40 = 3 THEN '' END AS phone,
         'Clerk' AS position, c_mktsegment AS department,
         CASE c_custkey % 4 WHEN 0 THEN '2020-01-15' WHEN 1 THEN '2021/03/04'
              WHEN 2 THEN '03/04/2022' ELSE 'someday' END AS hire_date,
         CASE WHEN c_custkey % 45 = 7 THEN 'n/a' ELSE CAST(CAST(c_acctbal AS DECIMAL(10,2)) AS VARCHAR) END AS salary
  FROM customer
)""",
    "staff_update_requests": """
staff_update_requests AS (
  SELECT s_suppkey AS seq,
         CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey + 100000 ELSE s_suppkey END AS id,
         CASE s_suppkey % 3 WHEN 0 THEN ['phone'] WHEN 1 THEN ['salary'] ELSE ['email', 'department'] END AS fields,
         '555-' || CAST(s_suppkey AS VARCHAR) AS new_phone,
         CAST(CASE WHEN s_suppkey % 7 = 1 THEN -1 ELSE s_suppkey + 1000 END AS DECIMAL(10,2)) AS new_salary,
         'staff' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS new_email,
         'HQ' AS new_department,
         CAST(NULL AS VARCHAR) AS new_name, CAST(NULL AS VARCHAR) AS new_position,
         CAST(NULL AS DATE) AS new_hire_date, CAST(NULL AS VARCHAR) AS new_status
  FROM supplier
  UNION ALL
  SELECT s_suppkey + 1000000000000000000, s_suppkey,
         CASE s_suppkey % 4 WHEN 0 THEN ['department'] ELSE ['phone', 'salary'] END,
         NULL, CAST(s_suppkey + 2000 AS DECIMAL(10,2)), NULL, 'Branch', NULL, NULL, NULL, NULL
  FROM supplier WHERE s_suppkey % 2 = 0
)""",
    "staff_status_requests": """
staff_status_requests AS (
  SELECT s_suppkey AS seq, s_suppkey AS id,
         ['active', 'inactive', 'terminated', 'retired'][s_suppkey % 4 + 1] AS status
  FROM supplier
)""",
    "budget_insert_requests": """
budget_insert_requests AS (
  SELECT m * 1000 + c.id AS seq, c.name AS category,
         CAST(CASE WHEN c.id = 3 THEN -5 ELSE c.id * 100 END AS DECIMAL(10,2)) AS amount,
         CAST(NULL AS DECIMAL(10,2)) AS spent,
         ['2024-01', '2024/02', 'Mar 2024', '202404', '2024-05-31'][m] AS month_year
  FROM categories c, range(1, 6) r(m)
)""",
    "budget_update_requests": """
budget_update_requests AS (
  SELECT id AS seq, CASE WHEN category = 'Pumps' THEN id + 50000 ELSE id END AS id,
         CASE id % 3 WHEN 0 THEN ['amount'] WHEN 1 THEN ['spent'] ELSE CAST([] AS VARCHAR[]) END AS fields,
         CAST(amount + 500 AS DECIMAL(10,2)) AS new_amount,
         CAST(CASE WHEN id % 2 = 0 THEN -1 ELSE spent + 1 END AS DECIMAL(10,2)) AS new_spent,
         CAST(NULL AS VARCHAR) AS new_category, CAST(NULL AS VARCHAR) AS new_month_year
  FROM budget
  UNION ALL
  SELECT id + 1000000000000000000, id,
         CASE id % 4 WHEN 0 THEN ['spent'] WHEN 1 THEN ['amount'] ELSE ['amount', 'spent'] END,
         CAST(amount + 700 AS DECIMAL(10,2)), CAST(spent + 3 AS DECIMAL(10,2)), NULL, NULL
  FROM budget WHERE id % 4 <> 3
)""",
    "sale_checks": """
sale_checks AS (
  SELECT * REPLACE (
    CASE WHEN id % 29 = 0 THEN NULL ELSE item_id END AS item_id,
    CASE WHEN id % 17 = 0 THEN 0 ELSE quantity END AS quantity,
    CASE WHEN id % 23 = 0 THEN CAST(-1 AS DECIMAL(10,2)) ELSE unit_price END AS unit_price,
    CASE WHEN id % 19 = 0 THEN '  ' ELSE customer_name END AS customer_name)
  FROM sales
)""",
    "staff_delete_requests": """
staff_delete_requests AS (
  SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 4 = 0 THEN -s_suppkey ELSE s_suppkey END AS id FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL
  SELECT s_suppkey + 1000000000000000000, CASE WHEN s_suppkey % 4 = 0 THEN -s_suppkey ELSE s_suppkey END
  FROM supplier WHERE s_suppkey % 15 = 0
)""",
    "budget_delete_requests": """
budget_delete_requests AS (
  SELECT id AS seq, id FROM budget WHERE id % 2 = 0
  UNION ALL SELECT id + 1000000000000000000, id FROM budget WHERE id % 6 = 0
)""",
    "transaction_requests": """
transaction_requests AS (
  SELECT id AS seq, CASE WHEN id % 17 = 0 THEN 'refund' ELSE type END AS type,
         CASE WHEN id % 19 = 0 THEN CAST(-1 AS DECIMAL(10,2)) ELSE amount END AS amount,
         CASE WHEN id % 23 = 0 THEN ' ' ELSE description END AS description, category, date, staff_id
  FROM transactions
)""",
    "remap_mapping": """
remap_mapping AS (
  SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS item_name,
         CASE WHEN p_size % 2 = 0 THEN 'Pumps' ELSE 'Valves' END AS category_name
  FROM part WHERE p_size > 45
)""",
}
CTES.update(REQUEST_CTES)
ORDER.extend(REQUEST_CTES)


def with_fixtures(body: str) -> str:
    """Prefix a query with every fixture CTE (DuckDB drops unused ones)."""
    ctes = ",\n".join(CTES[name].strip() for name in ORDER)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
