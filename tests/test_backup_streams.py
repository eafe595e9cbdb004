"""Backup / restore properties and the streaming jobs on small inputs."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import functions as F

from stockspark.operators.changes import sale_post
from stockspark.session import checkpoint_dir
from stockspark.sources import backup as A
from stockspark.sources.fixtures import Tables
from stockspark.streaming import streams as ST

from .conftest import SMOKE_DIR


def _scratch(spark, name):
    return f"{checkpoint_dir(spark)}/tests/{name}-{uuid.uuid4().hex}"


def _tables(spark):
    t = Tables(spark, SMOKE_DIR)
    return {n: getattr(t, n) for n in A.BACKUP_TABLES}, t


def test_round_trip_is_lossless(spark):
    tables, _ = _tables(spark)
    root = _scratch(spark, "bk")
    A.write_backup(tables, root)
    restored, status = A.read_backup(spark, root)
    assert all(r.missing == 0 and r.extra == 0 for r in A.round_trip_diff(tables, restored).collect())
    assert {r.table: (r.status, r.restored == r.total) for r in status.collect()} == {
        n: ("completed", True) for n in A.BACKUP_TABLES
    }


def test_restore_first_record_keys_unknown_table_and_bad_rows(spark):
    root = _scratch(spark, "bk")
    os.makedirs(f"{root}/data/staff")
    os.makedirs(f"{root}/data/users")
    with open(f"{root}/data/staff/part-0.json", "w") as fh:
        fh.write(json.dumps({"id": 1, "name": "A"}) + "\n")
        fh.write(json.dumps({"id": 2, "name": "B", "email": "b@x.io"}) + "\n")  # extra key: ignored
        fh.write('{"id": "not a number", "name": "C"}\n')  # does not fit the schema
        fh.write("{broken json\n")
    with open(f"{root}/data/users/part-0.json", "w") as fh:
        fh.write(json.dumps({"id": 1}) + "\n")
    frames, status = A.read_backup(spark, root, ["staff", "users", "budget"], own_keys=False)
    st = {r.table: (r.status, r.restored, r.total) for r in status.collect()}
    assert st == {"staff": ("completed", 2, 4), "users": ("skipped", 0, 0), "budget": ("skipped", 0, 0)}
    rows = sorted((r.id, r.name, r.email) for r in frames["staff"].collect())
    assert rows == [(1, "A", None), (2, "B", None)]


def test_restore_takes_each_records_own_keys(spark):
    root = _scratch(spark, "bk")
    os.makedirs(f"{root}/data/staff")
    with open(f"{root}/data/staff/part-0.json", "w") as fh:
        fh.write("{broken json\n")  # no reason to skip the table
        fh.write(json.dumps({"id": 1, "name": "A"}) + "\n")
    with open(f"{root}/data/staff/part-1.json", "w") as fh:
        fh.write(json.dumps({"id": 2, "name": "B", "email": "b@x.io"}) + "\n")
        fh.write(json.dumps({"phone": "7", "id": 3}) + "\n")
    frames, status = A.read_backup(spark, root, ["staff", "budget"])
    assert {r.table: (r.status, r.restored, r.total) for r in status.collect()} == {"staff": ("completed", 3, 4), "budget": ("skipped", 0, 0)}
    rows = sorted((r.id, r.name, r.email, r.phone) for r in frames["staff"].collect())
    assert rows == [(1, "A", None, None), (2, "B", "b@x.io", None), (3, None, None, "7")]


def test_table_preview_rejects_unknown_names(spark):
    tables, _ = _tables(spark)
    try:
        A.table_preview(tables, "users")
    except ValueError:
        pass
    else:
        raise AssertionError("users must not be previewable")
    assert A.table_preview(tables, "sales").count() == 100


def test_conform_to_schema_counts_failures(spark):
    from stockspark.schemas import STAFF

    src = spark.createDataFrame([("1", "A", "12.5"), ("x", "B", "1"), ("3", "C", "lots")], "id string, name string, salary string")
    good, bad = A.conform_to_schema(src, STAFF)
    assert [r.id for r in good.collect()] == [1]
    assert sorted(tuple(r.failed_columns) for r in bad.collect()) == [("id",), ("salary",)]


def test_column_evolution_and_seed(spark, frames):
    old = spark.createDataFrame([(1, "a", 5, 2)], "id long, name string, quantity int, minimum_stock int")
    row = A.column_evolution(old).first()
    assert row.min_quantity == 2 and row.sku is None
    row = A.column_evolution(old.drop("minimum_stock")).first()
    assert row.min_quantity == 0
    cats = frames.categories([{"id": 4, "name": " tools "}])
    seeded = A.seed_categories(cats).collect()
    assert len(seeded) == 9 and max(r.id for r in seeded) == 12


def test_sale_stream_equals_batch_in_several_files(spark):
    _, t = _tables(spark)
    root = _scratch(spark, "s1")
    ST.init_stock_state(t.inventory, f"{root}/state")
    req = t.sale_requests
    for lo, hi in [(1990, 1996), (1996, 1999), (1999, 2100)]:
        req.filter((F.year("requested_at") >= lo) & (F.year("requested_at") < hi)).write.mode("append").parquet(
            f"{root}/req"
        )
        ST.start_sale_post_stream(spark, f"{root}/req", f"{root}/state", f"{root}/ckpt").awaitTermination()
    streamed = {(r.request_id, r.status) for r in ST.read_outcomes(spark, f"{root}/state").collect()}
    batch = {(r.request_id, r.status) for r in sale_post(t.inventory, req).extra["outcomes"].collect()}
    assert streamed == batch


def test_daily_stream_emits_closed_days(spark):
    _, t = _tables(spark)
    root = _scratch(spark, "s2")
    t.sales.write.parquet(f"{root}/sales")
    ST.start_daily_sales_stream(spark, f"{root}/sales", f"{root}/out", f"{root}/ckpt").awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    all_days = t.sales.select(F.to_date("sale_date")).distinct().count()
    assert 0 < out.count() < all_days  # the still-open last days are not emitted yet
    assert out.groupBy("date").count().filter("count > 1").count() == 0


def test_daily_stream_with_open_days_has_every_sale(spark):
    _, t = _tables(spark)
    root = _scratch(spark, "s2open")
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):  # the second half changes days of the first
        t.sales.filter(part).write.mode("append").parquet(f"{root}/sales")
        ST.start_daily_sales_stream(spark, f"{root}/sales", f"{root}/out", f"{root}/ckpt", watermark="100000 days", open_days=True).awaitTermination()
    got = {r.date: (r.revenue, r.sales_count) for r in ST.read_daily_sales(spark, f"{root}/out").collect()}
    days = t.sales.groupBy(F.to_date("sale_date").alias("date")).agg(F.sum("total_price").alias("r"), F.count("*").alias("n"))
    assert got == {r.date: (r.r, r.n) for r in days.collect() if r.date is not None}


def test_backup_records_cover_every_row(spark):
    tables, _ = _tables(spark)
    rec = A.backup_records(tables)
    counts = {r.table: r["count"] for r in rec.groupBy("table").count().collect()}
    assert counts == {n: tables[n].count() for n in A.BACKUP_TABLES}
    one = json.loads(rec.filter("table = 'staff'").first().record)
    assert set(one) == {f.name for f in tables["staff"].schema.fields}  # NULL fields kept


def test_daily_stream_counts_late_rows_within_watermark(spark, frames):
    from decimal import Decimal

    from .conftest import TS

    root = _scratch(spark, "s2late")

    def batch(rows):
        frames.sales([
            {"id": i, "item_id": 1, "quantity": 1, "total_price": Decimal("1.00"), "sale_date": TS(ts)} for i, ts in rows
        ]).write.mode("append").parquet(f"{root}/sales")
        ST.start_daily_sales_stream(spark, f"{root}/sales", f"{root}/out", f"{root}/ckpt").awaitTermination()

    batch([(1, "2024-01-01 10:00:00"), (2, "2024-01-03 12:00:00")])  # watermark -> 2024-01-02 12:00
    batch([(3, "2024-01-02 18:00:00")])  # late but inside the watermark: counted for Jan 2
    batch([(4, "2024-01-01 23:00:00"), (5, "2024-01-06 00:00:00")])  # Jan 1 already closed: dropped
    out = {str(r.date): r.sales_count for r in spark.read.parquet(f"{root}/out").collect()}
    assert out == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-03": 1}


def test_sale_stream_replay_is_idempotent(spark):
    """Re-running the same batch (as after a failure) rewrites identical outputs."""
    _, t = _tables(spark)
    root = _scratch(spark, "s1replay")
    ST.init_stock_state(t.inventory, f"{root}/state")
    t.sale_requests.write.parquet(f"{root}/req")
    ST.start_sale_post_stream(spark, f"{root}/req", f"{root}/state", f"{root}/ckpt-a").awaitTermination()
    first = sorted(tuple(r) for r in ST.read_outcomes(spark, f"{root}/state").collect())
    stock1 = sorted(tuple(r) for r in ST.read_stock(spark, f"{root}/state").select("id", "quantity", "updated_at").collect())
    # a fresh checkpoint replays batch 0 over the same files and state version
    ST.start_sale_post_stream(spark, f"{root}/req", f"{root}/state", f"{root}/ckpt-b").awaitTermination()
    again = sorted(tuple(r) for r in ST.read_outcomes(spark, f"{root}/state").collect())
    stock2 = sorted(tuple(r) for r in ST.read_stock(spark, f"{root}/state").select("id", "quantity", "updated_at").collect())
    assert first == again and stock1 == stock2


def test_sale_stream_writes_changes_and_compacts(spark):
    """Base plus changes over several batches equals one posting; changes hold only items that sold."""
    _, t = _tables(spark)
    root = _scratch(spark, "s1changes")
    ST.init_stock_state(t.inventory, f"{root}/state")
    for lo, hi in [(1990, 1994), (1994, 1996), (1996, 1998), (1998, 1999), (1999, 2100)]:
        t.sale_requests.filter((F.year("requested_at") >= lo) & (F.year("requested_at") < hi)).write.mode("append").parquet(f"{root}/req")
        ST.start_sale_post_stream(spark, f"{root}/req", f"{root}/state", f"{root}/ckpt", compact_every=2).awaitTermination()
    key = lambda r: r.id
    streamed = [(r.id, r.quantity) for r in sorted(ST.read_stock(spark, f"{root}/state", compact_every=2).collect(), key=key)]
    posted = sale_post(t.inventory, t.sale_requests)
    assert streamed == [(r.id, r.quantity) for r in sorted(posted.snapshot.collect(), key=key)]
    assert os.path.isdir(f"{root}/state/stock/base/v=2") and os.path.isdir(f"{root}/state/stock/base/v=4") and not os.path.isdir(f"{root}/state/stock/base/v=1")
    changes = spark.read.parquet(f"{root}/state/stock/changes")
    sold = spark.read.parquet(f"{root}/state/sales").select("batch", F.col("item_id").alias("id")).distinct()
    assert changes.count() == sold.count() == changes.select("batch", "id").distinct().count()
    last = {r.item_id: r.at for r in posted.extra["accepted"].groupBy("item_id").agg(F.max("sale_date").alias("at")).collect()}
    assert {r.id: r.updated_at for r in ST.read_stock(spark, f"{root}/state", compact_every=2).collect() if r.updated_at} == last


def test_daily_ledger_counts_rows_of_any_age_once(spark, frames):
    from decimal import Decimal

    from .conftest import TS

    root = _scratch(spark, "s2ledger")
    width = spark.conf.get("spark.sql.shuffle.partitions")

    def batch(rows, checkpoint="ckpt"):
        if rows:
            frames.sales([{"id": i, "item_id": 1, "quantity": 1, "total_price": Decimal("1.00"), "sale_date": ts and TS(ts)} for i, ts in rows]).coalesce(1).write.mode("append").parquet(f"{root}/sales")
        ST.start_daily_sales_stream(spark, f"{root}/sales", f"{root}/out", f"{root}/{checkpoint}", open_days=True).awaitTermination()
        return {str(r.date): (r.sales_count, r.revenue) for r in ST.read_daily_sales(spark, f"{root}/out").collect()}

    batch([(1, "2024-01-02 10:00:00"), (2, "2024-01-10 12:00:00"), (3, None)])
    late = batch([(4, "2024-01-02 23:00:00"), (5, "2023-01-01 00:00:00")])  # far beyond any watermark
    assert late == {"2024-01-02": (2, Decimal("2.00")), "2024-01-10": (1, Decimal("1.00")), "2023-01-01": (1, Decimal("1.00"))}
    assert spark.conf.get("spark.sql.shuffle.partitions") == width


def test_manifest_finds_changed_cells_and_copies(spark, frames):
    """Same number of rows, other content: the digest differs."""
    import shutil

    tables, _ = _tables(spark)
    root = _scratch(spark, "bkdigest")
    manifest = A.write_backup(tables, root)
    assert {r.table: r.rows for r in manifest.collect()} == {n: df.count() for n, df in tables.items()}
    assert all(r.intact for r in A.verify_backup(spark, root).collect())
    for name, change in (("staff", lambda rows: [rows[0].replace('"status":"', '"status":"x'), *rows[1:]]), ("budget", lambda rows: [rows[1], *rows[1:]])):
        files = sorted(f for f in os.listdir(f"{root}/data/{name}") if f.startswith("part-"))
        kept = [line for f in files for line in open(f"{root}/data/{name}/{f}").read().splitlines()]
        shutil.rmtree(f"{root}/data/{name}")
        os.makedirs(f"{root}/data/{name}")
        with open(f"{root}/data/{name}/part-0.json", "w") as fh:
            fh.write("\n".join(change(kept)))
    spark.catalog.clearCache()
    state = {r.table: (r.rows == r.expected, r.intact) for r in A.verify_backup(spark, root).collect()}
    assert state == {"categories": (True, True), "inventory": (True, True), "sales": (True, True), "staff": (True, False), "budget": (True, False)}


def test_compressed_backups_and_records_parsed_once(spark, monkeypatch):
    """Compressed files come back whole, in files of bounded size; verifying parses a record in one place."""
    tables, _ = _tables(spark)
    root = _scratch(spark, "bkgzip")
    monkeypatch.setattr(A, "COMPRESSED_RECORDS", 20)
    A.write_backup(tables, root, compression="gzip")
    files = [f for f in os.listdir(f"{root}/data/staff") if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
    frames, _ = A.read_backup(spark, root)
    assert {(r.missing, r.extra) for r in A.round_trip_diff(tables, frames).collect()} == {(0, 0)}
    assert all(r.intact for r in A.verify_backup(spark, root).collect())
    assert frames["sales"]._jdf.queryExecution().executedPlan().toString().count("from_json(") == 1


def test_digest_is_the_exact_sum_of_the_hashes(spark):
    df = spark.range(3000).selectExpr("concat('r', id) as value")
    one = df.agg(*A._digest(F.col("value"))).first()
    hashes = [r.h for r in df.selectExpr("xxhash64(value) as h").collect()]
    again = [r.h for r in df.selectExpr("xxhash64(concat(value, '#')) as h").collect()]
    assert (one.rows, one.a, one.b) == (3000, str(sum(hashes)), str(sum(again)))
    assert tuple(df.limit(0).agg(*A._digest(F.col("value"))).first()) == (0, "0", "0")


def test_export_query_writes_compressed_files(spark):
    """The export's JSON lines are compressed and hold every row and cell of the tables."""
    import glob

    from stockspark.plans.registry import QUERIES

    tables, _ = _tables(spark)
    folders = lambda: set(glob.glob(f"{checkpoint_dir(spark)}/**/data", recursive=True))
    before = folders()
    manifest = {r.table: r.rows for r in QUERIES["backup_export"](spark, SMOKE_DIR).collect()}
    (data,) = folders() - before
    assert manifest == {n: df.count() for n, df in tables.items()}
    assert all(f.endswith(".gz") for n in tables for f in os.listdir(f"{data}/{n}") if f.startswith("part-"))
    frames, _ = A.read_backup(spark, os.path.dirname(data))
    assert {(r.missing, r.extra) for r in A.round_trip_diff(tables, frames).collect()} == {(0, 0)}


def test_stored_tables_leave_no_shuffle_files(spark):
    """What building a table shuffles is removed when the table is written; the session's setting comes back."""
    import time

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(f.getName()) for f in _all(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    _all = lambda found: [found.apply(i) for i in range(found.size())]
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffles(), spark.conf.get(key, None)
    t = Tables(spark, SMOKE_DIR)
    name = f"shuffled_{uuid.uuid4().hex}"
    rows = t._table(name, None, lambda: spark.range(5000).withColumn("k", F.col("id") % 7).repartition(5, "id").groupBy("k").count())
    for _ in range(50):  # they are removed in the background
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert spark.conf.get(key, None) == setting
    assert sum(r["count"] for r in rows.collect()) == 5000


def test_stored_tables_and_numberings_are_zstd_files(spark):
    """Tables and numbered copies take the disk of the small codec, with the same rows."""
    import glob

    from stockspark.plans.ordering import dense_number

    t = Tables(spark, SMOKE_DIR)
    t._table(name := f"small_{uuid.uuid4().hex}", None, lambda: spark.range(50))
    files = glob.glob(f"{checkpoint_dir(spark)}/stockspark/tables/*/{name}/part-*")
    assert files and all(f.endswith(".zstd.parquet") for f in files)
    folders = lambda: set(glob.glob(f"{checkpoint_dir(spark)}/stockspark/numbered-*"))
    before = folders()
    rows = dense_number(spark.range(50).selectExpr("99 - id as k"), "k", "n").collect()
    (made,) = folders() - before
    assert all(f.endswith(".zstd.parquet") for f in glob.glob(f"{made}/part-*"))
    assert sorted((r.k, r.n) for r in rows) == [(50 + i, i + 1) for i in range(50)]
