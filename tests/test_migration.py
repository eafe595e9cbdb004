"""Migration into a store with constraints: rows fail as they would one at a time."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stockspark.sources import migration as M

CAT = "id string, name string, description string, created_at string"
EMPTY = {
    "staff": "id string, name string, email string, phone string, position string, department string, hire_date string, salary string, status string, created_at string",
    "inventory": "id string, name string, category_id string, quantity string, unit_price string",
    "sales": "id string, item_id string, quantity string, unit_price string, total_price string, staff_id string",
    "budget": "id string, category string, amount string, spent string, month_year string, created_at string",
}


def sources(spark, **rows):
    layouts = {"categories": CAT, **EMPTY}
    return {n: spark.createDataFrame([tuple(r) + (None,) * (len(layouts[n].split(",")) - len(r)) for r in rows.get(n, [])], layouts[n]) for n in layouts}


def lost(m, table):
    return sorted((r.id, r.reason) for r in m.rejects.where(F.col("table") == table).collect())


def test_each_constraint_and_the_cascade_between_tables(spark):
    m = M.migrate(sources(
        spark,
        categories=[("1", "Tools"), ("2", "Tools"), ("3", None), ("x", "Pumps"), ("5", "y" * 101), ("6", "tools")],
        staff=[("1", "A", "a@x"), ("2", "B", "a@x"), ("3", "C"), ("4", "D"), ("5", "E", "e@x", "1" * 21)],
        inventory=[("1", "i", "1", "3", "2"), ("2", "j", "2", "3", "2"), ("3", "k", None, "3", "2"), ("4", "l", "1", "many", "2"), ("1", "again", "1", "3", "2")],
        sales=[("1", "1", "1", "1", "1", "1"), ("2", "2", "1", "1", "1", "1"), ("3", "1", "1", "1", "1", "2"), ("4", None, "1", "1", "1", None), ("5", "1", None, "1", "1", None)],
        budget=[("1", "Tools", "5", "1", "2024-01"), ("2", "Tools", "6", "1", "2024/01"), ("3", "Tools", "6", "1", "soon"), ("4", "Tools", "6", "1", "2024-02")],
    ))
    assert lost(m, "categories") == [("2", "unique:name"), ("3", "null:name"), ("5", "length:name"), ("x", "type:id")]
    assert lost(m, "staff") == [("2", "unique:email"), ("5", "length:phone")]
    assert [r for r in lost(m, "inventory") if r[0] != "1"] == [("2", "foreign:category_id"), ("4", "type:quantity")]
    assert [r for r in lost(m, "inventory") if r[0] == "1"] == [("1", "unique:id")]
    assert lost(m, "sales") == [("2", "foreign:item_id"), ("3", "foreign:staff_id"), ("5", "null:quantity")]
    assert lost(m, "budget") == [("2", "unique:category,month,year"), ("3", "null:month")]
    assert {r.table: (r.status, r.migrated, r.total) for r in m.report.collect()} == {
        "categories": ("completed", 2, 6), "staff": ("completed", 3, 5), "inventory": ("completed", 2, 5), "sales": ("completed", 2, 5), "budget": ("completed", 2, 4)
    }
    assert sorted(r.id for r in m.tables["inventory"].collect()) == [1, 3]


def test_empty_tables_are_skipped(spark):
    m = M.migrate(sources(spark))
    assert {(r.status, r.migrated, r.total) for r in m.report.collect()} == {("skipped", 0, 0)} and m.rejects.count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_two_unique_keys_settle_like_inserting_one_by_one(spark, seed):
    rng = random.Random(seed)
    rows = list({(str(rng.randint(1, 25)), f"n{rng.randint(1, 25)}") for _ in range(150)}) + [("90", "hot")] + [(str(100 + i), "hot") for i in range(60)]
    m = M.migrate(sources(spark, categories=rows))
    ids, names, want = set(), set(), []
    for i, name in sorted(rows, key=lambda r: (int(r[0]), r[1])):
        if i in ids or name in names:
            continue
        ids.add(i)
        names.add(name)
        want.append((int(i), name))
    assert sorted((r.id, r.name) for r in m.tables["categories"].collect()) == sorted(want)


def test_children_are_not_moved_to_find_their_parents(spark, monkeypatch):
    """Parents beyond the broadcast size: the rows meet only the values without a parent, which are few."""
    root = f"{M.checkpoint_dir(spark)}/tests/orphans-{M.uuid.uuid4().hex}"
    spark.range(20_000).write.parquet(f"{root}/parents")
    rows = spark.range(60_000).selectExpr("id % 20003 as item_id", "cast(null as string) as _reason", "id as _row")
    rows.where("_row > 10").unionByName(spark.sql("select cast(null as bigint) item_id, cast(null as string) _reason, 3L _row")).write.parquet(f"{root}/rows")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8KB")
    try:
        judged = M._without_parent(spark.read.parquet(f"{root}/rows"), "item_id", spark.read.parquet(f"{root}/parents"), f"{root}/orphans")
        plan = judged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert {(r.item_id, r.n) for r in judged.where("_reason = 'foreign:item_id'").groupBy("item_id").agg(F.count("*").alias("n")).collect()} == {(20000, 2), (20001, 2), (20002, 2)}
        assert judged.count() == 59_990 and judged.columns == ["item_id", "_reason", "_row"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
