"""Backups in one JSON document, read in byte ranges that cut anywhere."""

from __future__ import annotations

import json
import os
import random
import uuid

import pytest

from stockspark.session import checkpoint_dir
from stockspark.sources import backup as A
from stockspark.sources import document as D
from stockspark.sources.fixtures import Tables

from .conftest import SMOKE_DIR


@pytest.fixture
def small_ranges(spark):
    """Files are split into ranges of about 1,500 bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _scratch(spark, name):
    path = f"{checkpoint_dir(spark)}/tests/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


NASTY = ['{', '}', '"', '\\', '\\"', '[{"a": 1}]', "é😀", "\n", "", '"data": {"sales": [', "x" * 500, "\\\\", ","]


def _document(rng, layout):
    def record(i):
        return {"id": i, "name": "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 4))), "tags": [1, [2]], "more": {"deep": [{"k": rng.choice(NASTY)}]}}

    data = {n: [record(i) for i in range(k)] for n, k in (("categories", 12), ("inventory", 40), ("empty", 0), ("sta\\ff\"", 7), ("sales", 90), ("users", 1))}
    doc = {"timestamp": "2024-01-01", "other": {"data": [{"id": "no record"}], "x": {"y": 1}}, "data": data, "version": "1.0"}
    return data, json.dumps(doc, **layout)


@pytest.mark.parametrize("layout", [{"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_reads_every_record_whatever_the_ranges_cut(spark, small_ranges, layout):
    data, text = _document(random.Random(4), layout)
    path = _scratch(spark, "doc")
    with open(f"{path}/backup.json", "w") as fh:
        fh.write(text)
    records, names = D.read_document(spark, f"{path}/backup.json")
    assert spark.read.option("lineSep", "{").text(path).rdd.getNumPartitions() > 10
    assert names == list(data)
    got: dict = {}
    for r in records.collect():
        got.setdefault(r.table, []).append(json.loads(r.record))
    assert {n: sorted(v, key=lambda x: x["id"]) for n, v in got.items()} == {n: v for n, v in data.items() if v}


def test_document_equals_the_directory_form(spark, small_ranges):
    t = Tables(spark, SMOKE_DIR)
    tables = {n: getattr(t, n).limit(30).orderBy("id") if n == "sales" else getattr(t, n) for n in A.BACKUP_TABLES}
    tables = {n: spark.createDataFrame(df.collect(), df.schema) for n, df in tables.items()}
    path = _scratch(spark, "written")
    D.write_document(tables, path, timestamp="2024-01-01")
    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    whole = json.loads("".join(open(f"{path}/{f}").read() for f in parts))
    assert {n: len(v) for n, v in whole["data"].items()} == {n: df.count() for n, df in tables.items()}
    assert [r["id"] for r in whole["data"]["staff"]] == sorted(r["id"] for r in whole["data"]["staff"])
    frames, status = D.read_backup_document(spark, path)
    assert all(r.status == "completed" and r.restored == r.total for r in status.collect())
    assert all(r.missing == 0 and r.extra == 0 for r in A.round_trip_diff(tables, frames).collect())


def test_tables_without_rows_unknown_ones_and_bad_records(spark):
    path = _scratch(spark, "odd")
    with open(f"{path}/b.json", "w") as fh:
        fh.write('{"data": {"staff": [{"id": 1, "name": "A"}, {"id": "x"}, {"phone": "7", "id": 3}], "budget": [ ], "users": [{"id": 1}]}}')
    frames, status = D.read_backup_document(spark, path)
    assert {r.table: (r.status, r.restored, r.total) for r in status.collect()} == {"staff": ("completed", 2, 3), "budget": ("skipped", 0, 0), "users": ("skipped", 0, 0)}
    assert sorted((r.id, r.name, r.phone) for r in frames["staff"].collect()) == [(1, "A", None), (3, None, "7")]


def test_an_empty_backup_is_a_document(spark):
    t = Tables(spark, SMOKE_DIR)
    path = _scratch(spark, "none")
    D.write_document({n: getattr(t, n).limit(0) for n in A.BACKUP_TABLES}, path)
    records, names = D.read_document(spark, path)
    assert names == list(A.BACKUP_TABLES) and records.count() == 0


def test_batches_may_end_anywhere_and_records_are_parsed_once(spark, small_ranges):
    """What is found does not depend on how Arrow cuts a range; a restored table's plan parses a record in one place."""
    data, text = _document(random.Random(8), {"indent": 1})
    path = _scratch(spark, "doc")
    with open(f"{path}/backup.json", "w") as fh:
        fh.write(text)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        records, names = D.read_document(spark, f"{path}/backup.json")
        got = sorted((r.table, r.record) for r in records.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert names == list(data)
    assert sorted(((n, json.loads(r)) for n, r in got), key=str) == sorted(((n, r) for n, rows in data.items() for r in rows), key=str)
    frames, _ = D.read_backup_document(spark, f"{path}/backup.json")
    plan = frames["sales"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def _whole(path):
    import gzip

    parts = sorted(f for f in os.listdir(path) if f.startswith("part-"))
    raw = b"".join(open(f"{path}/{f}", "rb").read() for f in parts)
    return parts, json.loads(gzip.decompress(raw) if parts[0].endswith(".gz") else raw)


def test_compressed_parts_are_one_document_and_nothing_else_is_stored(spark, monkeypatch):
    """Parts put together are the compressed document, sorted by id; copies and null ids stay, no second copy of the lines is kept."""
    monkeypatch.setattr(A, "COMPRESSED_RECORDS", 7)
    rows = spark.range(40).selectExpr("if(id % 9 = 0, null, id div 2) id", "concat('n{', id div 2, '\"') name")
    path = _scratch(spark, "gzip")
    stored = lambda: {d for d in os.listdir(f"{checkpoint_dir(spark)}/stockspark") if d.startswith("document-")}
    os.makedirs(f"{checkpoint_dir(spark)}/stockspark", exist_ok=True)
    before = stored()
    D.write_document({"categories": rows.where("id > 100"), "staff": rows, "budget": rows.limit(0)}, path, compression="gzip")
    assert stored() == before
    parts, whole = _whole(path)
    assert len(parts) > 6 and all(f.endswith(".gz") for f in parts)
    assert {n: len(v) for n, v in whole["data"].items()} == {"categories": 0, "staff": 40, "budget": 0}
    ids = [r["id"] for r in whole["data"]["staff"]]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    assert sorted(map(str, whole["data"]["staff"])) == sorted(str(r.asDict()) for r in rows.collect())
    records, names = D.read_document(spark, path)
    assert names == ["categories", "staff", "budget"]
    assert sorted(str(json.loads(r.record)) for r in records.collect()) == sorted(map(str, whole["data"]["staff"]))


def test_rows_that_change_with_every_run_give_a_whole_document(spark):
    """Every partition is chosen for rows that do not come again; no record lacks its comma."""
    import time

    from pyspark.sql import functions as F

    now = F.udf(lambda i: time.time_ns(), "bigint").asNondeterministic()
    rows = spark.range(60).select(now("id").alias("id"), F.col("id").alias("n"))
    path = _scratch(spark, "moving")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        D.write_document({"staff": rows, "budget": spark.range(2)}, path)
    finally:
        spark.conf.set(key, before)
    data = _whole(path)[1]["data"]
    assert sorted(r["n"] for r in data["staff"]) == list(range(60)) and len(data["budget"]) == 2


@pytest.mark.parametrize("key", ["backup_document_restore", "backup_document_round_trip"])
def test_document_queries_write_compressed_parts_and_skip_other_tables(spark, key, monkeypatch):
    from stockspark.plans.registry import QUERIES

    written, restored, plans = [], D.restored, []
    write = D.write_document
    monkeypatch.setattr(D, "write_document", lambda tables, path, *a, **b: (written.append(path), write(tables, path, *a, **b)))
    monkeypatch.setattr(D, "restored", lambda lines, name: (plans.append(lines._jdf.queryExecution().executedPlan().toString()), restored(lines, name))[1])
    rows = QUERIES[key](spark, SMOKE_DIR).collect()
    parts, whole = _whole(written[0])
    assert all(f.endswith(".gz") for f in parts)
    t = Tables(spark, SMOKE_DIR)
    counts = {n: getattr(t, n).count() for n in A.BACKUP_TABLES}
    assert {n: len(v) for n, v in whole["data"].items()} == counts
    if key == "backup_document_restore":
        assert {r.table: (r.restored, r.total) for r in rows} == {n: (c, c) for n, c in counts.items()}
    else:
        assert {(r.table, r.missing, r.extra) for r in rows} == {(n, 0, 0) for n in counts}
    assert len(plans) == 5 and all("PushedFilters" in p and "GreaterThan(at," in p for p in plans)
