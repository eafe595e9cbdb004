"""Migration into a store with constraints.

Tables move in dependency order.  A row fails, and is kept with its reason, when

* a value does not convert to the target type (``type:<column>``),
* a required value is missing (``null:<column>``) or a text too long (``length:<column>``),
* it refers to a row that did not arrive (``foreign:<column>``), which cascades from table to table,
* an earlier row that did arrive has the same unique key (``unique:<columns>``).

Rows come in id order, then by their unique keys (rows that agree in these: in any order).  With several unique keys
"earlier row that did arrive" is itself a chain: a row that loses by one key does not block
another by its other key.  Rounds settle it: a row that is the first open one by all its keys
arrives, all that share a key with it fail, the rest is open for the next round.  Only rows of
keys that occur twice take part, so a round handles the conflicts, not the table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import BUDGET_FORM_B, CATEGORIES, INVENTORY, SALES, STAFF
from ..session import checkpoint_dir
from .backup import _union_all, budget_as_form_b


@dataclass(frozen=True)
class Target:
    """Layout and constraints of one target table."""

    schema: T.StructType
    required: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...]
    lengths: dict[str, int] = field(default_factory=dict)
    foreign: dict[str, str] = field(default_factory=dict)  # column -> table whose id it names


# The constraints of the target store, in the order in which tables move.
TARGETS = {
    "categories": Target(CATEGORIES, ("id", "name"), (("id",), ("name",)), {"name": 100}),
    "staff": Target(
        STAFF, ("id", "name"), (("id",), ("email",)),
        {"name": 100, "email": 100, "phone": 20, "position": 100, "department": 100, "status": 20},
    ),
    "inventory": Target(
        INVENTORY, ("id", "name"), (("id",),), {"name": 200, "sku": 100, "supplier": 200, "location": 100}, {"category_id": "categories"},
    ),
    "sales": Target(
        SALES, ("id", "quantity", "unit_price", "total_price"), (("id",),),
        {"customer_name": 200, "customer_phone": 20, "payment_method": 50}, {"item_id": "inventory", "staff_id": "staff"},
    ),
    "budget": Target(BUDGET_FORM_B, ("id", "category", "allocated_amount", "month", "year"), (("id",), ("category", "month", "year")), {"category": 100}),
}


@dataclass
class Migration:
    """Rows that arrived, per table; (table, id, reason) of those that did not; (table, status, migrated, total)."""

    tables: dict[str, DataFrame]
    rejects: DataFrame
    report: DataFrame


def _checked(source: DataFrame, target: Target) -> DataFrame:
    """Target columns, the id as it came (``_id``), what is wrong with the values (``_reason``), a row number."""
    cells, faults = [], []
    for f in target.schema.fields:
        if f.name not in source.columns:
            cells.append(F.lit(None).cast(f.dataType).alias(f.name))
            if f.name in target.required:
                faults.append(F.lit(f"null:{f.name}"))
            continue
        given, value = F.col(f.name), F.col(f.name).try_cast(f.dataType)
        cells.append(value.alias(f.name))
        faults.append(F.when(given.isNotNull() & value.isNull(), F.lit(f"type:{f.name}")))
        if f.name in target.required:
            faults.append(F.when(given.isNull(), F.lit(f"null:{f.name}")))
        if f.name in target.lengths:
            faults.append(F.when(F.length(value) > target.lengths[f.name], F.lit(f"length:{f.name}")))
    key = F.col("id").cast("string") if "id" in source.columns else F.lit(None).cast("string")
    return source.select(*cells, key.alias("_id"), F.coalesce(*faults).alias("_reason"), F.monotonically_increasing_id().alias("_row"))


def _stored(df: DataFrame, path: str) -> DataFrame:
    """Written and read back: Spark then knows its size, and joins what is small without moving the other side."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _without_parent(rows: DataFrame, column: str, parents: DataFrame, path: str) -> DataFrame:
    """Add the reason for rows whose ``column`` names no row of ``parents``; nulls (each its own key here) are fine.

    Only the distinct values of ``column`` are compared with the parents; the rows meet the
    values that have none, which are few in most tables, so the rows themselves are not shuffled.
    """
    named = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_orphan")).distinct()
    orphans = _stored(named.join(parents.select(F.col("id").alias("_orphan")), "_orphan", "left_anti"), path)
    asked = rows.withColumn("_asked", F.coalesce(F.col(column), -F.col("_row") - 1))
    lost = F.col(column).isNotNull() & F.col("_orphan").isNotNull()
    return asked.join(orphans, F.col("_asked") == F.col("_orphan"), "left").withColumn(
        "_reason", F.coalesce("_reason", F.when(lost, F.lit(f"foreign:{column}")))
    ).drop("_asked", "_orphan")


def _losers(rows: DataFrame, unique: tuple[tuple[str, ...], ...], root: str) -> DataFrame | None:
    """(_row, _lost) of the rows that an earlier row of the same unique key keeps out; None: there are none."""
    spark = rows.sparkSession
    columns = list(dict.fromkeys(c for key in unique for c in key))
    turn = F.struct(*["id", *[c for c in columns if c != "id"], "_same", "_row"]).alias("_turn")
    ordered = rows.withColumn("_same", F.xxhash64(*[c for c in rows.columns if not c.startswith("_")])).select(*columns, turn, "_row")
    twice = []
    for k, key in enumerate(unique):
        shared = ordered.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        for c in key:  # rows without a full key have none
            shared = shared.where(F.col(c).isNotNull())
        shared = _stored(shared.drop("_n"), f"{root}-shared-{k}")
        twice.append(ordered.join(shared, list(key), "left_semi").select(*ordered.columns))
    open_ = _union_all(twice).dropDuplicates(["_row"])
    losers = None
    turns = 0
    while True:
        open_.write.parquet(f"{root}-open-{turns}")
        open_ = spark.read.schema(open_.schema).parquet(f"{root}-open-{turns}")
        if open_.isEmpty():
            return losers
        winners = open_
        for i, key in enumerate(unique):
            full = F.lit(True)
            for c in key:
                full = full & F.col(c).isNotNull()
            first = open_.where(full).groupBy(*[F.col(c).alias(f"_k{j}") for j, c in enumerate(key)]).agg(F.min("_turn").alias(f"_first{i}"))
            same = F.lit(True)
            for j, c in enumerate(key):
                same = same & (F.col(c) == F.col(f"_k{j}"))
            winners = winners.join(first, same, "left").where(F.col(f"_first{i}").isNull() | (F.col(f"_first{i}") == F.col("_turn"))).select(*open_.columns)
        winners.write.parquet(f"{root}-won-{turns}")
        winners = spark.read.schema(open_.schema).parquet(f"{root}-won-{turns}")
        rest = open_.join(winners.select("_row"), "_row", "left_anti")
        beaten = _union_all([
            rest.join(winners.select(*key).dropDuplicates(), list(key), "left_semi").select("_row", F.lit(i).alias("_i")) for i, key in enumerate(unique)
        ]).groupBy("_row").agg(F.min("_i").alias("_i"))
        names = F.element_at(F.array(*[F.lit("unique:" + ",".join(key)) for key in unique]), F.col("_i") + 1)
        beaten.select("_row", names.alias("_lost")).write.parquet(f"{root}-lost-{turns}")
        beaten = spark.read.schema("_row bigint, _lost string").parquet(f"{root}-lost-{turns}")
        losers = beaten if losers is None else losers.unionByName(beaten)
        open_ = rest.join(beaten, "_row", "left_anti")
        turns += 1


def migrate(sources: dict[str, DataFrame], targets: dict[str, Target] | None = None) -> Migration:
    """Move ``sources`` (raw rows, budget in either layout) into the target tables."""
    targets = targets or TARGETS
    spark = next(iter(sources.values())).sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/stockspark/migration-{uuid.uuid4().hex}"
    arrived: dict[str, DataFrame] = {}
    rejects, report = [], []
    for name, target in targets.items():
        source = sources[name]
        if name == "budget" and "month_year" in source.columns:
            source = budget_as_form_b(source)
        # row numbers are written once: a recomputed source could number its rows differently
        rows = _checked(source, target)
        rows.write.parquet(f"{root}/{name}-in")
        rows = spark.read.schema(rows.schema).parquet(f"{root}/{name}-in")
        for column, parent in target.foreign.items():
            rows = _without_parent(rows, column, arrived[parent], f"{root}/{name}-orphans-{column}")
        lost = _losers(rows.where("_reason is null"), target.unique, f"{root}/{name}")
        if lost is not None:
            rows = rows.join(lost, "_row", "left").withColumn("_reason", F.coalesce("_reason", "_lost")).drop("_lost")
        judged = rows.drop("_row")
        judged.write.parquet(f"{root}/{name}-out")
        judged = spark.read.schema(judged.schema).parquet(f"{root}/{name}-out")
        arrived[name] = judged.where("_reason is null").select(*target.schema.names)
        rejects.append(judged.where("_reason is not null").select(F.lit(name).alias("table"), F.col("_id").alias("id"), F.col("_reason").alias("reason")))
        counts = judged.agg(F.count_if(F.col("_reason").isNull()).alias("migrated"), F.count(F.lit(1)).alias("total"))
        status = F.when(F.col("total") == 0, F.lit("skipped")).otherwise(F.lit("completed"))
        report.append(counts.select(F.lit(name).alias("table"), status.alias("status"), "migrated", "total"))
    return Migration(arrived, _union_all(rejects), _union_all(report))
