"""Listings and reports on tiny frames: empty tables, NULLs, zero divisors, date ends."""

from __future__ import annotations

from stockspark.operators import listings as B
from stockspark.operators import reports as C

from .conftest import D, TS


def test_empty_inventory_summary(spark, frames):
    row = C.inventory_summary(frames.inventory([])).first()
    assert row.total_items == 0 and row.total_stock is None and row.low_stock_items == 0


def test_inventory_by_category_keeps_empty_categories_last(spark, frames):
    cats = frames.categories([{"id": 1, "name": "Tools"}, {"id": 2, "name": "Empty"}])
    inv = frames.inventory([{"id": 1, "name": "a", "category_id": 1, "quantity": 2, "unit_price": D(3)}])
    rows = C.inventory_by_category(cats, inv).collect()
    assert [(r.category, r.item_count, r.total_value) for r in rows] == [("Tools", 1, D(6)), ("Empty", 0, None)]


def test_null_min_quantity_is_never_low(spark, frames):
    inv = frames.inventory([
        {"id": 1, "name": "a", "quantity": 0, "min_quantity": None},
        {"id": 2, "name": "b", "quantity": 0, "min_quantity": 0},
    ])
    cats = frames.categories([])
    assert [r.id for r in B.low_stock_items(inv, cats).collect()] == [2]
    assert B.low_stock_alerts_top10(inv, cats).count() == 0  # min_quantity > 0 required


def test_date_range_end_day_semantics(spark, frames):
    inv = frames.inventory([{"id": 1, "name": "a"}])
    staff = frames.staff([])
    sales = frames.sales([
        {"id": 1, "item_id": 1, "quantity": 1, "total_price": D(1), "sale_date": TS("2024-01-31 00:00:00")},
        {"id": 2, "item_id": 1, "quantity": 1, "total_price": D(1), "sale_date": TS("2024-01-31 15:00:00")},
        {"id": 3, "item_id": 1, "quantity": 1, "total_price": D(1), "sale_date": TS("2024-02-01 00:00:00")},
    ])
    # listing compares dates: the whole end day counts
    assert {r.id for r in B.sales_date_range(sales, inv, staff, "2024-01-01", "2024-01-31").collect()} == {1, 2}
    # report compares timestamps: the end day counts up to 00:00 only
    rows = C.sales_by_date(sales, "2024-01-01", "2024-01-31").collect()
    assert [(str(r.date), r.sales_count) for r in rows] == [("2024-01-31", 1)]


def test_search_term_with_percent_is_a_wildcard(spark, frames):
    inv = frames.inventory([{"id": 1, "name": "ab"}, {"id": 2, "name": "a-b"}, {"id": 3, "name": "b"}])
    cats = frames.categories([])
    assert [r.id for r in B.inventory_search(inv, cats, "a%b").collect()] == [2, 1]  # by name: "a-b" < "ab"
    assert [r.id for r in B.inventory_search_contains(inv, cats, "").collect()] == [2, 1, 3]


def test_profit_margin_zero_price_is_null(spark, frames):
    inv = frames.inventory([{"id": 1, "name": "a", "unit_price": D(0)}, {"id": 2, "name": "b", "unit_price": D(2)}])
    sales = frames.sales([
        {"id": 1, "item_id": 1, "quantity": 1, "unit_price": D(4)},
        {"id": 2, "item_id": 2, "quantity": 1, "unit_price": D(3)},
    ])
    got = {r.name: r.profit_margin for r in C.profit_margin(inv, sales).collect()}
    assert got == {"a": None, "b": 50.0}


def test_budget_vs_actual_zero_budget(spark, frames):
    b = frames.budget([{"id": 1, "category": "X", "amount": D(0), "spent": D(5), "month_year": "2024-01"}])
    row = B.budget_vs_actual(b, "X", "2024-01-15").first()
    assert row.percentage_used is None and row.remaining == D(-5)


def test_staff_without_sales_and_orphans(spark, frames):
    staff = frames.staff([
        {"id": 1, "name": "A", "status": "active"},
        {"id": 2, "name": "B", "status": "active"},
        {"id": 3, "name": "C", "status": "inactive"},
    ])
    inv = frames.inventory([{"id": 1, "name": "i"}])
    sales = frames.sales([
        {"id": 1, "item_id": 1, "staff_id": 1, "quantity": 2, "total_price": D(4)},
        {"id": 2, "item_id": 99, "staff_id": 1, "quantity": 1, "total_price": D(6)},  # orphan sale
    ])
    perf = {r.staff_name: (r.total_sales, r.revenue) for r in C.staff_performance(staff, sales).collect()}
    assert perf == {"A": (2, D(10)), "B": (0, None)}  # orphans counted, inactive dropped
    totals = {r.staff_id: (r.totalSales, r.totalTransactions) for r in C.staff_sales_totals(staff, sales, inv).collect()}
    assert totals[1] == (D(4), 1) and totals[2] == (D(0), 0)


def test_monthly_trend_filled_has_twelve_months(spark, frames):
    sales = frames.sales([{"id": 1, "total_price": D(2), "sale_date": TS("2001-03-05 10:00:00")}])
    rows = C.monthly_trend_filled(sales, 2001).collect()
    assert len(rows) == 12 and rows[2].month == "Mar" and rows[2].revenue == D(2) and rows[0].sales_count == 0
    assert [r.month for r in C.monthly_trend(sales, 2001).collect()] == ["March"]


def test_comprehensive_on_empty_tables(spark, frames):
    row = C.comprehensive(frames.inventory([]), frames.sales([]), frames.staff([])).first()
    assert row.total_items == 0 and row.total_sales == 0 and row.average_sale is None and row.active_staff == 0
    assert C.budget_summary(frames.budget([])).first().total_budget == D(0)
