"""Property tests: ordered folds equal their sequential definitions."""

from __future__ import annotations

from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from stockspark.operators import changes as E

from .conftest import D

OPS = st.lists(
    st.tuples(st.integers(1, 3), st.sampled_from(["add", "subtract", "set"]), st.integers(-5, 30)),
    min_size=0,
    max_size=40,
)
SALES = st.lists(st.tuples(st.integers(1, 3), st.integers(1, 12)), min_size=0, max_size=40)
STOCK = st.dictionaries(st.integers(1, 3), st.integers(0, 40), min_size=3, max_size=3)
# Few examples (each runs Spark jobs); no shrinking phase, so a failure reports fast.
SETTINGS = settings(
    max_examples=4,
    deadline=None,
    suppress_health_check=list(HealthCheck),
    phases=[Phase.explicit, Phase.reuse, Phase.generate],
)


@SETTINGS
@given(stock=STOCK, ops=OPS)
def test_stock_adjust_equals_loop(spark, frames, stock, ops):
    inv = frames.inventory([{"id": i, "name": str(i), "quantity": q} for i, q in stock.items()])
    rows = [(seq * 7, item, op, n) for seq, (item, op, n) in enumerate(ops)]
    df = spark.createDataFrame(rows, "seq bigint, item_id bigint, operation string, quantity int")
    got = {r.id: r.quantity for r in E.stock_adjust(inv, df, width=4).snapshot.collect()}
    for item, q in stock.items():
        for _, i, op, n in rows:
            if i == item:
                q = q + n if op == "add" else max(0, q - n) if op == "subtract" else max(0, n)
        assert got[item] == q


@SETTINGS
@given(stock=STOCK, reqs=SALES)
def test_sale_post_equals_loop_both_paths(spark, frames, stock, reqs):
    from .test_changes import _requests

    inv = frames.inventory([{"id": i, "name": str(i), "quantity": q, "unit_price": D(1)} for i, q in stock.items()])
    rows = [(rid, item, n, f"2024-03-01 00:{rid // 60:02d}:{rid % 60:02d}") for rid, (item, n) in enumerate(reqs)]
    req = _requests(spark, rows)
    want, left = {}, dict(stock)
    for rid, item, n, _ in rows:
        ok = left[item] >= n
        want[rid] = "accepted" if ok else "insufficient_stock"
        left[item] -= n if ok else 0
    for rows_of_a_slice in (None, 2):
        res = E.sale_post(inv, req, slice_rows=rows_of_a_slice)
        assert {r.request_id: r.status for r in res.extra["outcomes"].collect()} == want
        assert {r.id: r.quantity for r in res.snapshot.collect()} == left
