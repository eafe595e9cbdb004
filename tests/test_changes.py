"""Write jobs on tiny frames: ordering, rejection, clamping and properties."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockspark.operators import changes as E
from stockspark.plans.ordering import dense_number, monoid_fold
from stockspark.sources.fixtures import Tables

from .conftest import D, SMOKE_DIR, TS


def _inv(frames, stock: dict[int, int]):
    return frames.inventory([
        {"id": i, "name": f"item {i}", "quantity": q, "min_quantity": 1, "unit_price": D(2)} for i, q in stock.items()
    ])


def _ops(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, item_id bigint, operation string, quantity int")


def _python_adjust(q, ops):
    for op, n in ops:
        q = q + n if op == "add" else max(0, q - n) if op == "subtract" else max(0, n)
    return q


def test_stock_adjust_set_subtract_add(spark, frames):
    inv = _inv(frames, {1: 5, 2: 7})
    ops = _ops(spark, [(1, 1, "set", 3), (2, 1, "subtract", 10), (3, 1, "add", 4), (4, 3, "add", 1), (5, 2, "bogus", 1)])
    res = E.stock_adjust(inv, ops)
    q = {r.id: r.quantity for r in res.snapshot.collect()}
    assert q == {1: 4, 2: 7}
    assert sorted((r.seq, r.reason) for r in res.rejects.collect()) == [(4, "item_not_found"), (5, "invalid_request")]


def test_stock_adjust_add_is_not_clamped(spark, frames):
    inv = _inv(frames, {1: 2})
    res = E.stock_adjust(inv, _ops(spark, [(1, 1, "add", -5)]))
    assert res.snapshot.first().quantity == -3


def test_stock_adjust_matches_sequential_loop_across_levels(spark, frames):
    import random

    rnd = random.Random(7)
    rows, stock = [], {i: rnd.randint(0, 50) for i in range(1, 6)}
    for seq in range(0, 3000, 3):  # sparse seqs: several buckets per item
        rows.append((seq, rnd.randint(1, 5), rnd.choice(["add", "subtract", "set"]), rnd.randint(-3, 20)))
    inv = _inv(frames, stock)
    res = E.stock_adjust(inv, _ops(spark, rows), width=16)  # 3 fold levels
    got = {r.id: r.quantity for r in res.snapshot.collect()}
    for item, q0 in stock.items():
        mine = [(op, n) for _, i, op, n in sorted(rows) if i == item]
        assert got[item] == _python_adjust(q0, mine), item


def test_single_set_is_idempotent(spark, frames):
    inv = _inv(frames, {1: 9})
    ops = _ops(spark, [(1, 1, "set", 4)])
    once = E.stock_adjust(inv, ops).snapshot
    twice = E.stock_adjust(once, ops).snapshot
    assert once.first().quantity == twice.first().quantity == 4


def _requests(spark, rows):
    schema = T.StructType([
        T.StructField("request_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", T.DecimalType(10, 2)),
        T.StructField("customer_name", T.StringType()),
        T.StructField("customer_phone", T.StringType()),
        T.StructField("staff_id", T.LongType()),
        T.StructField("requested_at", T.TimestampNTZType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("notes", T.StringType()),
    ])
    full = [(rid, item, q, D(3), "c", None, None, TS(ts), "cash", None) for rid, item, q, ts in rows]
    return spark.createDataFrame(full, schema)


def test_sale_post_exact_stock_then_one_more(spark, frames):
    inv = _inv(frames, {1: 5})
    req = _requests(spark, [
        (10, 1, 5, "2024-01-01 10:00:00"),  # exactly the stock
        (11, 1, 1, "2024-01-01 11:00:00"),  # one more
        (12, 9, 1, "2024-01-01 09:00:00"),  # unknown item
    ])
    res = E.sale_post(inv, req)
    out = {r.request_id: r.status for r in res.extra["outcomes"].collect()}
    assert out == {10: "accepted", 11: "insufficient_stock", 12: "item_not_found"}
    assert res.snapshot.first().quantity == 0
    acc = res.extra["accepted"].first()
    assert acc.total_price == D(15)


def test_sale_post_order_and_conservation(spark, frames):
    import random

    rnd = random.Random(3)
    stock = {i: rnd.randint(0, 30) for i in range(1, 5)}
    rows = [(rid, rnd.randint(1, 4), rnd.randint(1, 12), f"2024-01-{1 + rid % 28:02d} {rid % 24:02d}:00:00") for rid in range(200)]
    inv = _inv(frames, stock)
    res = E.sale_post(inv, _requests(spark, rows))
    new = {r.id: r.quantity for r in res.snapshot.collect()}
    acc = res.extra["accepted"].groupBy("item_id").agg(F.sum("quantity").alias("q")).collect()
    sold = {r.item_id: r.q for r in acc}
    for item, q0 in stock.items():
        assert new[item] >= 0
        assert new[item] + sold.get(item, 0) == q0
        # sequential reference
        q, ok = q0, set()
        for rid, i, n, ts in sorted(rows, key=lambda r: (r[3], r[0])):
            if i == item and q >= n:
                q -= n
                ok.add(rid)
        assert new[item] == q
    got_ok = {r.request_id for r in res.extra["outcomes"].filter("status = 'accepted'").collect()}
    want_ok = set()
    for item, q0 in stock.items():
        q = q0
        for rid, i, n, ts in sorted(rows, key=lambda r: (r[3], r[0])):
            if i == item and q >= n:
                q -= n
                want_ok.add(rid)
    assert got_ok == want_ok


def test_sale_delete_restores_stock_after_post(spark, frames):
    inv = _inv(frames, {1: 8})
    req = _requests(spark, [(1, 1, 3, "2024-01-01 00:00:00"), (2, 1, 4, "2024-01-02 00:00:00")])
    posted = E.sale_post(inv, req)
    sales = posted.extra["accepted"]
    back = E.sale_delete(sales, posted.snapshot, sales.select(F.col("id").alias("seq"), "id"))
    assert back.extra["inventory"].first().quantity == 8
    assert back.snapshot.count() == 0


def test_category_insert_trim_lower_duplicates(spark, frames):
    cats = frames.categories([{"id": 1, "name": "Tools"}])
    req = spark.createDataFrame(
        [(1, "  tools ", None), (2, "Pumps", "  "), (3, " PUMPS", "x"), (4, "x", None), (5, "A & B", "d")],
        "seq bigint, name string, description string",
    )
    res = E.category_insert(cats, req)
    added = {r.seq: (r.id, r.name, r.description) for r in res.extra["added"].collect()}
    assert added == {2: (2, "Pumps", None), 5: (3, "A &amp; B", "d")}
    assert sorted((r.seq, r.reason) for r in res.rejects.collect()) == [
        (1, "duplicate_name"), (3, "duplicate_name"), (4, "invalid_name")
    ]


def test_inventory_update_partial_and_null(spark, frames):
    inv = frames.inventory([
        {"id": 1, "name": "A", "quantity": 1, "supplier": "s", "unit_price": D(1)},
        {"id": 2, "name": "B", "quantity": 2, "supplier": "t", "unit_price": D(1)},
    ])
    from stockspark.sources.requests import INVENTORY_NEW_COLS, _nulls

    req = spark.createDataFrame(
        [(1, 1, ["supplier"], None), (2, 2, ["name"], " a "), (3, 3, ["quantity"], None), (4, 2, [], None)],
        "seq bigint, id bigint, fields array<string>, new_name string",
    )
    req = _nulls(req.withColumn("new_supplier", F.lit(None).cast("string")), INVENTORY_NEW_COLS)
    res = E.inventory_update(inv, req, "2024-02-01 00:00:00")
    snap = {r.id: r for r in res.snapshot.collect()}
    assert snap[1].supplier is None and snap[1].name == "A" and snap[1].updated_at is not None
    assert snap[2].name == "B" and snap[2].updated_at is None
    assert sorted((r.seq, r.reason) for r in res.rejects.collect()) == [
        (2, "duplicate_name"), (3, "invalid_value"), (4, "no_fields")
    ]


def test_sale_update_zero_price_not_used_for_total(spark, frames):
    sales = frames.sales([{"id": 1, "item_id": 1, "quantity": 2, "unit_price": D(5), "total_price": D(10)}])
    from stockspark.sources.requests import SALES_NEW_COLS, _nulls

    req = spark.createDataFrame([(1, 1, ["unit_price"])], "seq bigint, id bigint, fields array<string>")
    req = _nulls(req.withColumn("new_unit_price", F.lit(0).cast("decimal(10,2)")), SALES_NEW_COLS)
    row = E.sale_update(sales, req).snapshot.first()
    assert row.unit_price == D(0) and row.total_price == D(10)


def test_transaction_post_adds_expenses_to_month(spark, frames):
    budget = frames.budget([
        {"id": 1, "category": "Tools", "amount": D(100), "spent": D(5), "month_year": "2024-01"},
        {"id": 2, "category": "Tools", "amount": D(100), "spent": D(0), "month_year": "2024-02"},
    ])
    tx = frames.transactions([
        {"id": 1, "type": "expense", "amount": D(10), "description": "a", "category": "Tools", "date": TS("2024-01-31 23:59:59")},
        {"id": 2, "type": "income", "amount": D(50), "description": "b", "category": "Tools", "date": TS("2024-01-02 00:00:00")},
        {"id": 3, "type": "expense", "amount": D(7), "description": "c", "category": "Pumps", "date": TS("2024-01-02 00:00:00")},
        {"id": 4, "type": "refund", "amount": D(1), "description": "d", "category": "Tools", "date": TS("2024-01-02 00:00:00")},
    ]).withColumnRenamed("id", "seq")
    res = E.transaction_post(budget, tx, tx)
    spent = {r.id: r.spent for r in res.snapshot.collect()}
    assert spent == {1: D(15), 2: D(0)}
    assert [r.reason for r in res.rejects.collect()] == ["invalid:type_valid"]


def test_budget_insert_month_forms(spark, frames):
    budget = frames.budget([{"id": 5, "category": "Tools", "amount": D(1), "spent": D(0), "month_year": "2024-01"}])
    req = spark.createDataFrame(
        [(1, "Tools", 10.0, "2024/01"), (2, "Tools", 10.0, "202402"), (3, "Tools", 10.0, "Jan 2024"),
         (4, "Tools", -1.0, "2024-03"), (5, "Tools", 3.0, "2024-02-15")],
        "seq bigint, category string, amount double, month_year string",
    ).withColumn("amount", F.col("amount").cast("decimal(10,2)")).withColumn("spent", F.lit(None).cast("decimal(10,2)"))
    res = E.budget_insert(budget, req)
    added = [(r.id, r.month_year, r.spent) for r in res.extra["added"].collect()]
    assert added == [(6, "2024-02", D(0))]
    assert sorted((r.seq, r.reason) for r in res.rejects.collect()) == [
        (1, "duplicate_budget"), (3, "invalid_month"), (4, "invalid:amount_nonnegative"), (5, "duplicate_budget")
    ]


def test_dense_number_many_partitions(spark):
    df = spark.range(0, 20000).select((F.col("id") * 13 + 5).alias("seq")).repartition(17)
    out = dense_number(df, "seq", "n", 1000)
    rows = sorted((r.seq, r.n) for r in out.collect())
    assert [n for _, n in rows] == list(range(1001, 21001))


def test_dense_number_by_several_columns(spark):
    """As by one struct of them, nulls first."""
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 11 != 0, -F.col("id")).alias("b"), "id").repartition(9)
    got = {r.id: r.n for r in dense_number(df.where("b is not null or id < 7"), ["a", "b", "id"], "n").collect()}
    rows = sorted((i % 7, i % 11 != 0, -i if i % 11 else i, i) for i in range(5000) if i % 11 or i < 7)
    assert got == {r[3]: n for n, r in enumerate(rows, 1)}


def test_sales_are_sorted_before_what_the_sort_does_not_need(spark):
    """A range sort evaluates its rows twice, so prices and texts of a sale are derived after it."""
    t = Tables(spark, SMOKE_DIR)
    assert "sale_date" in t._build_sales().columns and "unit_price" not in t._build_sales().columns
    plain = Tables(spark, SMOKE_DIR, materialize=False)
    assert plain.sales.schema.simpleString() == t.sales.schema.simpleString()
    assert plain.sales.exceptAll(t.sales).count() == t.sales.exceptAll(plain.sales).count() == 0


def test_monoid_fold_is_ordered(spark):
    # string concatenation is associative but not commutative
    df = spark.range(0, 500).select(F.lit(1).alias("k"), F.col("id").alias("seq"), F.col("id").cast("string").alias("v"))
    identity = F.struct(F.lit("").alias("v"))
    out = monoid_fold(df, "k", "seq", ["v"], identity, lambda a, b: F.struct(F.concat(a["v"], b["v"]).alias("v")), 8)
    assert out.first().acc.v == "".join(str(i) for i in range(500))


def test_sale_post_in_slices_matches_one_pass(spark, frames):
    import random

    rnd = random.Random(11)
    stock = {i: rnd.randint(0, 40) for i in range(1, 7)}
    rows = [(rid, rnd.randint(1, 6), rnd.randint(1, 15), f"2024-02-{1 + rid % 28:02d} {rid % 24:02d}:{rid % 60:02d}:00") for rid in range(400)]
    inv = _inv(frames, stock)
    req = _requests(spark, rows)
    fold = E.sale_post(inv, req)
    hot = E.sale_post(inv, req, slice_rows=9)  # every item spans many slices
    a = sorted((r.request_id, r.status) for r in fold.extra["outcomes"].collect())
    b = sorted((r.request_id, r.status) for r in hot.extra["outcomes"].collect())
    assert a == b
    assert sorted((r.id, r.quantity) for r in fold.snapshot.collect()) == sorted(
        (r.id, r.quantity) for r in hot.snapshot.collect()
    )


def test_running_sum_splits_hot_key(spark):
    from stockspark.plans.ordering import running_sum

    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 10 < 8, F.lit(1)).otherwise(F.col("id") % 10).alias("k"),
        F.col("id").alias("o"),
        (F.col("id") % 7).alias("v"),
    )
    got = {r.o: r.s for r in running_sum(df, "k", ["o"], "v", "s").collect()}
    acc = {}
    for o in range(3000):
        k = 1 if o % 10 < 8 else o % 10
        acc[k] = acc.get(k, 0) + o % 7
        assert got[o] == acc[k]


def test_partial_updates_of_one_id_all_apply(spark, frames):
    from stockspark.sources.requests import SALES_NEW_COLS, _nulls

    sales = frames.sales([{"id": 1, "item_id": 1, "quantity": 2, "unit_price": D(5), "total_price": D(10)}])
    req = spark.createDataFrame(
        [(1, 1, ["quantity"], 3, None, None), (2, 1, ["notes"], None, None, "late"), (3, 1, ["unit_price"], None, 0, None)],
        "seq bigint, id bigint, fields array<string>, new_quantity int, _p int, new_notes string",
    ).withColumn("new_unit_price", F.col("_p").cast("decimal(10,2)")).drop("_p")
    row = E.sale_update(sales, _nulls(req, SALES_NEW_COLS)).snapshot.first()
    assert (row.quantity, row.notes, row.unit_price, row.total_price) == (3, "late", D(0), D(15))


def test_second_delete_finds_nothing(spark, frames):
    inv = frames.inventory([{"id": 1, "name": "A", "quantity": 1, "unit_price": D(1)}])
    req = spark.createDataFrame([(1, 1), (2, 1), (3, 9)], "seq bigint, id bigint")
    res = E.rows_delete(inv, req)
    assert res.snapshot.count() == 0
    assert sorted((r.seq, r.reason) for r in res.rejects.collect()) == [(2, "not_found"), (3, "not_found")]


def _admitted(spark, rows, stock, slice_rows):
    """{request_id: accepted} of (request_id, item_id, quantity) rows in request order."""
    from stockspark.plans.admission import admit

    full = [(item, rid, TS("2024-01-01 00:00:00"), n, stock[item]) for rid, item, n in rows]
    df = spark.createDataFrame(full, "item_id long, request_id long, requested_at timestamp_ntz, quantity int, stock int")
    return {r.request_id: r.accepted for r in admit(df, slice_rows).collect()}


def _one_by_one(rows, stock):
    left, out = dict(stock), {}
    for rid, item, n in sorted(rows):
        out[rid] = n <= left[item]
        left[item] -= n if out[rid] else 0
    return out


def test_admission_alternating_small_and_one_more_than_the_rest(spark):
    """Every slice of the item blocks: it is settled slice by slice, with the next item in between."""
    stock, rows, left = {1: 150, 2: 40}, [], 150
    for rid in range(0, 300, 2):
        rows.append((rid, 1, 1))
        left -= 1
        rows.append((rid + 1, 1, left + 1))
    rows += [(rid, 2, 1 + rid % 3) for rid in range(1000, 1060)]
    want = _one_by_one(rows, stock)
    assert sum(want[r] for r in range(300)) == 150
    assert _admitted(spark, rows, stock, slice_rows=20) == want


def test_admission_slices_of_one_hot_item(spark):
    import random

    rnd = random.Random(5)
    rows = [(rid, 7 if rid % 10 else rid % 4, rnd.choice([1, 2, 30, 400])) for rid in range(1500)]
    for total in (50, 3000, 10**9):
        stock = {0: 10, 2: 0, 7: total}
        assert _admitted(spark, rows, stock, slice_rows=100) == _one_by_one(rows, stock)
    assert _admitted(spark, [], {}, slice_rows=10) == {}


def test_small_slices_do_not_make_a_file_each(spark):
    import os

    from stockspark.plans import admission
    from stockspark.session import checkpoint_dir

    rows = [(rid, 1 + rid % 3, 1 + rid % 5) for rid in range(1200)]
    stock = {1: 300, 2: 500, 3: 10**6}
    base = checkpoint_dir(spark).removeprefix("file:") + "/stockspark"
    known = set(os.listdir(base)) if os.path.isdir(base) else set()
    assert _admitted(spark, rows, stock, slice_rows=1) == _one_by_one(rows, stock)
    (mine,) = [d for d in os.listdir(base) if d.startswith("admission-") and d not in known]
    files = [f for f in os.listdir(f"{base}/{mine}/passed") if f.endswith(".parquet")]
    assert 1 < len(files) <= admission.MOST_SLICES  # was one for each of the 1,200 requests


def test_sale_post_marks_and_numbers_what_it_sells(spark, frames):
    inv = _inv(frames, {1: 5, 2: 5})
    sales = frames.sales([{"id": 40, "item_id": 1, "quantity": 1, "unit_price": D(1), "total_price": D(1)}])
    req = _requests(spark, [(9, 1, 2, "2024-01-02 10:00:00"), (8, 1, 1, "2024-01-03 10:00:00"), (7, 2, 6, "2024-01-01 10:00:00")])
    res = E.sale_post(inv, req, "2024-02-01 00:00:00", sales)
    assert {r.id: (r.quantity, r.updated_at) for r in res.snapshot.collect()} == {1: (2, TS("2024-02-01 00:00:00")), 2: (5, None)}
    assert [r.id for r in res.extra["changed"].collect()] == [1]
    assert sorted((r.id, r.quantity, r.sale_date) for r in res.extra["accepted"].collect()) == [
        (41, 2, TS("2024-01-02 10:00:00")), (42, 1, TS("2024-01-03 10:00:00"))
    ]
    back = E.sale_delete(sales, inv, spark.createDataFrame([(1, 40)], "seq bigint, id bigint"), "2024-02-01 00:00:00")
    assert {r.id: (r.quantity, r.updated_at) for r in back.extra["inventory"].collect()} == {1: (6, TS("2024-02-01 00:00:00")), 2: (5, None)}


def test_inserts_create_at_the_job_time_and_rejects_need_no_ids(spark, frames, monkeypatch):
    cats = frames.categories([{"id": 3, "name": "Tools"}])
    req = spark.createDataFrame([(1, "Pumps", None), (2, "pumps", None)], "seq bigint, name string, description string")
    row = E.category_insert(cats, req, "2024-02-01 00:00:00").extra["added"].first()
    assert (row.id, row.created_at) == (4, TS("2024-02-01 00:00:00"))
    monkeypatch.setattr(E, "dense_number", lambda *a, **k: (_ for _ in ()).throw(AssertionError("numbered")))
    assert [r.seq for r in E.category_insert(cats, req).rejects.collect()] == [2]


def test_transactions_get_new_ids(spark, frames):
    row = {"type": "expense", "amount": D(10), "description": "a", "category": "Tools", "date": TS("2024-01-31 00:00:00")}
    old = frames.transactions([{"id": 1, **row}, {"id": 5, **row}])
    req = frames.transactions([{"id": 1, **row}, {"id": 2, **row, "type": "gift"}, {"id": 3, **row}]).withColumnRenamed("id", "seq")
    res = E.transaction_post(frames.budget([]), old, req)
    assert sorted((r.seq, r.id) for r in res.extra["posted"].collect()) == [(1, 6), (3, 7)]
    assert sorted(r.id for r in res.extra["transactions"].collect()) == [1, 5, 6, 7]
