"""Order-dependent building blocks that stay distributed.

* ``dense_number``: 1..n numbering in a unique order without a global
  window (a global ``row_number`` pulls every row into one task).
* ``monoid_fold``: fold an associative, order-dependent combine per key over
  rows sorted by a unique sequence number, in levels of bounded groups, so a
  key that holds a third of all rows is still split across many tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id(): partition id << 33 | row index


def dense_number(df: DataFrame, order_col: str | list[str], out_col: str, start: Column | int = 0, parts: int = 0) -> DataFrame:
    """Add ``out_col`` = start + 1, 2, ... following the unique ``order_col`` (several columns sort faster than one struct of them).

    Rows are range-partitioned and sorted by ``order_col``; the row index
    inside each partition comes from ``monotonically_increasing_id`` and a
    per-partition offset (one small row per partition, broadcast) is added.
    Deterministic: the partitioned rows are written once (as Parquet: a
    checkpoint would keep them uncompressed), so offsets and row indexes
    always describe the same partitioning.  ``parts``: at least so many
    partitions, where the shuffle partitions are too few for the table.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stockspark/numbered-{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    start_col = start if isinstance(start, Column) else F.lit(start)
    order = [order_col] if isinstance(order_col, str) else order_col
    # Range boundaries come from sampling, which may differ between two
    # evaluations; writing fixes one partitioning for both uses below
    # (and cuts the lineage, so a lost executor does not renumber rows).
    ranged = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_p", F.shiftright("_mid", _ROW_BITS))
        .withColumn("_i", F.col("_mid").bitwiseAND((1 << _ROW_BITS) - 1))
        .drop("_mid")
    )
    ranged.write.option("compression", "zstd").parquet(path)
    parts = spark.read.schema(ranged.schema).parquet(path)
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    # One row per partition: a bounded, broadcastable table.
    offsets = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_off"))
    return (
        parts.join(F.broadcast(offsets), "_p")
        .withColumn(out_col, (start_col + F.col("_off") + F.col("_i") + 1).cast("bigint"))
        .drop("_p", "_i", "_off")
    )


def monoid_fold(
    df: DataFrame,
    key: str,
    seq: str,
    fields: list[str],
    identity: Column,
    combine: Callable[[Column, Column], Column],
    width: int = 1 << 17,
) -> DataFrame:
    """Fold ``struct(fields)`` per ``key`` in ``seq`` order with an associative ``combine``.

    ``seq`` must be a unique non-negative BIGINT.  Level 0 groups rows by
    (key, seq div width); each group holds at most ``width`` rows because seq
    is unique.  Each level folds its sorted group into one summary and the
    next level groups summaries by (key, bucket div width), until one summary
    per key remains.  Returns (key, struct ``acc``) with the folded fields.
    """
    max_seq = df.agg(F.max(seq)).first()[0]
    levels = 1
    span = width
    while max_seq is not None and span <= max_seq:
        span *= width
        levels += 1

    cur = df.select(key, F.col(seq).cast("bigint").alias("_pos"), F.struct(*fields).alias("_v"))
    for _ in range(levels):
        cur = (
            cur.withColumn("_bucket", F.floor(F.col("_pos") / width).cast("bigint"))
            .groupBy(key, "_bucket")
            .agg(F.array_sort(F.collect_list(F.struct("_pos", "_v"))).alias("_items"))
            .select(
                key,
                F.col("_bucket").alias("_pos"),
                F.aggregate("_items", identity, lambda acc, x: combine(acc, x["_v"])).alias("_v"),
            )
        )
    # After the last level every key has a single summary (bucket 0).
    return cur.select(key, F.col("_v").alias("acc"))


def running_sum(df: DataFrame, key: str, order_cols: list[str], value: str, out: str) -> DataFrame:
    """Exact running sum of ``value`` per ``key`` in ``order_cols`` order, skew-safe.

    Rows are range-partitioned on (key, order), which splits a hot key over
    several partitions (the partitioner samples the data).  Each task sums
    its own slice; per (key, partition) totals (at most one row per key and
    partition) give the offset of every slice.  The partitioned rows are
    checkpointed so the partition ids are stable for both uses.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, key, *order_cols).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    w_local = Window.partitionBy("_part", key).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.withColumn("_local", F.sum(value).over(w_local))
    totals = parts.groupBy(key, "_part").agg(F.sum(value).alias("_tot"))
    offsets = totals.select(
        key, "_part", (F.sum("_tot").over(Window.partitionBy(key).orderBy("_part")) - F.col("_tot")).alias("_off")
    )
    return (
        local.join(offsets, [key, "_part"])
        .withColumn(out, F.col("_local") + F.col("_off"))
        .drop("_part", "_local", "_off")
    )


def next_change(df: DataFrame, key: str, order: str, value: str, fields: list[str], out: str) -> DataFrame:
    """Add ``out``: ``fields`` of the key's next row, in (unique) ``order``, that has another ``value``; null where none follows.

    Skew-safe: rows are range-partitioned on (key, order), which splits a hot key.  Inside a
    partition the next row that differs from the row before it is the answer; behind a
    partition's end three rows per key and partition stand for the rest (its first row, the first
    that differs from that, its last).  The partitioned rows are checkpointed, as in
    ``running_sum``.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cell = F.struct(value, F.struct(*fields).alias("f"))

    def following(rows: DataFrame, group: list[str], by: list[str]) -> DataFrame:
        """``_next``: the next cell of the group that differs in value from the one before it."""
        sorted_ = Window.partitionBy(*group)
        differs = F.lag("_cell").over(sorted_.orderBy(*by))[value] != F.col("_cell")[value]
        marked = rows.withColumn("_start", F.when(differs, F.col("_cell")))
        behind = sorted_.orderBy(*[F.col(c).desc() for c in by]).rowsBetween(Window.unboundedPreceding, -1)
        return marked.withColumn("_next", F.last("_start", ignorenulls=True).over(behind))

    parts = df.withColumn("_cell", cell).repartitionByRange(n, key, order).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    local = following(parts, ["_part", key], [order])
    edges = local.groupBy(key, "_part").agg(
        F.min_by("_cell", order).alias("a"), F.min_by("_start", F.when(F.col("_start").isNotNull(), F.col(order))).alias("b"), F.max_by("_cell", order).alias("c")
    )
    few = edges.select(key, "_part", F.posexplode(F.array("a", "b", "c")).alias("_i", "_cell")).where("_cell is not null")
    after = following(few, [key], ["_part", "_i"]).where("_i = 2").select(key, "_part", F.col("_next").alias("_after"))
    joined = local.join(after, [key, "_part"], "left")
    return joined.withColumn(out, F.coalesce("_next", "_after")["f"]).drop("_part", "_cell", "_start", "_next", "_after")
