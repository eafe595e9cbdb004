"""Raw request bodies, trigram search and bucketed tables."""

from __future__ import annotations

import os
import uuid

import pytest
from pyspark.sql import functions as F

from stockspark.operators import changes as E
from stockspark.operators import raw_quality as RQ
from stockspark.session import checkpoint_dir
from stockspark.sources import requests as R
from stockspark.sources import search_index as SI
from stockspark.sources.buckets import bucketed
from stockspark.sources.fixtures import Tables

from .conftest import SMOKE_DIR

BODIES = [
    ('{"item_id": 1, "quantity": 2, "unit_price": 1.5, "customer_name": "a"}', ""),
    ('{"item_id": "1", "quantity": "+2", "unit_price": ".5", "customer_name": 7, "staff_id": "3"}', ""),
    ('{"item_id": "abc", "quantity": 1.5, "unit_price": "free", "customer_name": ""}', "item_id_int,quantity_at_least_1,unit_price_nonnegative,customer_name_required"),
    ('{"item_id": "", "quantity": 0, "unit_price": -0.1, "customer_name": null, "staff_id": null}', "item_id_int,quantity_at_least_1,unit_price_nonnegative,customer_name_required,staff_id_int"),
    ('{"item_id": 2.0, "quantity": 3.000, "unit_price": "1e3", "customer_name": "x", "staff_id": 1.5}', "staff_id_int"),
    ('{"item_id": 99999999999999999999, "quantity": true, "unit_price": "1.", "customer_name": "x"}', "item_id_int,quantity_at_least_1"),
    ("[1]", "item_id_int,quantity_at_least_1,unit_price_nonnegative,customer_name_required"),
    ("{oops", "item_id_int,quantity_at_least_1,unit_price_nonnegative,customer_name_required"),
    (None, "item_id_int,quantity_at_least_1,unit_price_nonnegative,customer_name_required"),
]


def test_raw_bodies_are_judged_before_they_are_typed(spark):
    df = spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BODIES)], "seq int, json string")
    got = {r.seq: r.failed_rules for r in RQ.report(df, "sales").collect()}
    assert got == {i: f for i, (_, f) in enumerate(BODIES) if f}
    counts = {r.rule: r.failures for r in RQ.rule_counts(df, "sales").collect()}
    assert counts == {r.name: sum(r.name in f.split(",") for _, f in BODIES) for r in RQ.RULES["sales"]}
    cells = {r.seq: r for r in RQ.checked(df, "sales").collect()}
    assert (cells[1].quantity.value, cells[2].quantity.value, cells[2].quantity.text, cells[4].quantity.value) == (2, None, "1.5", 3)
    assert (cells[0].staff_id.given, cells[3].staff_id.given, cells[3].staff_id.value) == (False, True, None)


def test_a_raw_body_is_read_once_per_field(spark):
    df = spark.createDataFrame(list(enumerate(b for b, _ in BODIES)), "seq int, json string")
    plan = RQ.report(df, "sales")._jdf.queryExecution().optimizedPlan().toString()
    # the field itself and its text; a filter moved below the fields had over a hundred
    assert 0 < plan.count("try_variant_get(") <= 2 * len(RQ.RULES["sales"])


def _stored(spark, df, name):
    path = f"{checkpoint_dir(spark)}/tests/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


TERMS = ["widget", "WIDGET 0", "SKU-1_", "a_c%xyz", "zz", "%", "100\\%", "é", "İst", "nothing at all", "_0_", "", "bolt%nut"]


@pytest.mark.parametrize("like", [True, False])
def test_search_finds_what_a_full_scan_finds_in_fewer_files(spark, like):
    words = ["Widget", "bolt", "NUT", "abcxyz", "İstanbul", "100% wool", "zz top", None, "", "É"]
    rows = [(i, f"{words[i // 40]} {i}" if words[i // 40] is not None else None, words[(i * 7) % 10], f"SKU-{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, name string, description string, sku string").repartitionByRange(10, "id")
    path = _stored(spark, df, "searched")
    index = f"{path}-index"
    columns = ["name", "description", "sku"]
    SI.write_index(spark, path, columns, index)
    table = spark.read.parquet(path)
    for term in TERMS:
        hit = F.lit(False)
        for c in columns:
            one = F.col(c).ilike(f"%{term}%") if like else F.contains(F.lower(F.col(c)), F.lower(F.lit(term)))
            hit = hit | F.coalesce(one, F.lit(False))
        assert sorted(r.id for r in SI.search(spark, path, index, columns, term, like).collect()) == sorted(r.id for r in table.where(hit).collect()), term
    found = SI.search(spark, path, index, ["name"], "Widget", like)
    assert 0 < len(found.inputFiles()) < len(table.inputFiles()) == 10
    assert SI.search(spark, path, index, columns, "nothing at all", like).count() == 0


def _exchanges_above_scan(df, table_column):
    """Whether the rows of the scan that reads ``table_column`` pass an exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    scans = [i for i, line in enumerate(plan) if "Scan parquet" in line or "FileScan parquet" in line]
    scan = next(i for i in scans if table_column in plan[i] and "Bucketed: true" in plan[i])
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|("))
    at, above = depth(plan[scan]), []
    for line in reversed(plan[:scan]):
        if depth(line) < at:
            at = depth(line)
            above.append(line)
    return any("Exchange" in line for line in above)


def test_jobs_on_bucketed_tables_leave_the_table_in_place(spark):
    t = Tables(spark, SMOKE_DIR)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many requests
    try:
        sales = bucketed(t.sales)
        updated = E.sale_update(sales, R.sale_update_requests(t)).snapshot
        deleted = E.sale_delete(sales, t.inventory, R.sale_delete_requests(t)).snapshot
        kept = E.rows_delete(sales, R.sale_delete_requests(t)).snapshot
        for df in (updated, deleted, kept):
            assert not _exchanges_above_scan(df, "customer_name")
        assert sorted(map(tuple, updated.collect()), key=str) == sorted(map(tuple, E.sale_update(t.sales, R.sale_update_requests(t)).snapshot.collect()), key=str)
        assert deleted.count() == kept.count() == t.sales.where("coalesce(notes, '') <> 'returned'").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert os.path.isdir(checkpoint_dir(spark))


def test_buckets_follow_the_rows(spark, monkeypatch):
    """A bucket is sorted by one task, so a large table has more of them than the session has shuffle partitions."""
    from stockspark.sources import buckets

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 100, raising=False)
    df = spark.range(100 * (width + 3))
    stored = bucketed(df)
    assert stored.select(F.input_file_name()).distinct().count() > width and stored.count() == df.count()
