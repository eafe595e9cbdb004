"""Ordered admission: requests take from a falling stock, first come, first served.

A request is accepted when the current stock covers it; the stock then drops.  The outcome
depends on order, yet no key is gathered:

* Candidates are range-partitioned by (key, order).  The part of a key inside one partition is a
  *slice*.  A slice that begins its key is settled at once, in one linear ordered pass over the
  sorted partition (Spark sorts and spills; the pass holds one number).
* Only the first slice of a partition can continue a key of the partition before, so at most one
  slice per partition stays open: their totals and minima are one small row per partition.
* Rounds over the open slices, in order: a slice whose smallest request exceeds the stock is
  rejected whole (stock only falls), slices are accepted whole while their totals fit, and the
  first one that does not fit is settled by the linear pass, for all keys in the same job.  A key
  needs at most as many rounds as it has slices.

Everything that later steps read again is written to the shared folder first: range borders come
from a sample, so a recomputed partitioning could differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Slices asked for by ``slice_rows`` are at most this many (a partition and a file each); more rows make them longer, a pass holds one number.
MOST_SLICES = 256
#: Requests of a slice that one task sorts; more rows give more slices.
SORTED_ROWS = 1_000_000

#: What a pass reads, and what it adds: the slice, the decision (null: open) and the stock then left.
_READ = ["item_id", "request_id", "requested_at", "quantity", "stock"]
_ROWS = "item_id bigint, request_id bigint, requested_at timestamp_ntz, quantity bigint, stock bigint, part int, accepted boolean, left bigint"
_FIELDS = pa.schema([
    ("item_id", pa.int64()), ("request_id", pa.int64()), ("requested_at", pa.timestamp("us")), ("quantity", pa.int64()), ("stock", pa.int64()),
    ("part", pa.int32()), ("accepted", pa.bool_()), ("left", pa.int64()),
])


def _pass(batches: Iterable[pa.RecordBatch], later: bool) -> Iterator[pa.RecordBatch]:
    """The linear pass over rows sorted by key and order; with ``later`` the first key stays open (it may continue)."""
    part = TaskContext.get().partitionId()
    now, left, open_ = None, 0, False
    for batch in batches:
        accepted: list[bool | None] = []
        lefts = []
        for item, n, stock in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
            if item != now:
                open_ = later and part > 0 and now is None
                now, left = item, stock
            if open_:
                accepted.append(None)
            elif n <= left:
                left -= n
                accepted.append(True)
            else:
                accepted.append(False)
            lefts.append(left)
        rows = len(lefts)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * rows, pa.int32()), pa.array(accepted, pa.bool_()), pa.array(lefts, pa.int64())],
            schema=_FIELDS,
        )


def _first(batches):
    return _pass(batches, later=True)


def _blocked(batches):
    return _pass(batches, later=False)


class _Key:
    """Open slices of one key, in order, and what is known of it."""

    def __init__(self, stock: int, slices: list[tuple[int, int, int]]):
        self.stock, self.slices, self.at = stock, slices, 0
        self.whole: list[tuple[int, bool]] = []  # (part, accepted) of slices decided as a whole

    def advance(self) -> int | None:
        """Decides slices as wholes up to the first that does not fit; its part, or None at the end."""
        while self.at < len(self.slices):
            part, total, least = self.slices[self.at]
            self.at += 1
            if least > self.stock:
                self.whole.append((part, False))
            elif total <= self.stock:
                self.stock -= total
                self.whole.append((part, True))
            else:
                return part
        return None


def admit(candidates: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """(item_id, request_id, quantity, accepted) of every candidate.

    ``candidates``: item_id, request_id, requested_at, quantity (positive), stock (at the start);
    a key's requests are in (requested_at, request_id) order.  There are as many slices as
    shuffle partitions, or enough for ``slice_rows`` requests each (up to MOST_SLICES) and for
    SORTED_ROWS at most: tasks, files and rounds follow the size of the work, not a small
    ``slice_rows``.  The candidates are written first, so their number and the borders of the
    slices do not compute them again.
    """
    spark = candidates.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/stockspark/admission-{uuid.uuid4().hex}"
    cells = candidates.select(*[F.col(c).cast("timestamp_ntz" if c == "requested_at" else "bigint").alias(c) for c in _READ])
    cells.write.parquet(f"{root}/candidates")
    cells = spark.read.schema(cells.schema).parquet(f"{root}/candidates")
    rows = cells.count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // SORTED_ROWS))
    if slice_rows:
        n = max(n, min(-(-rows // slice_rows), MOST_SLICES))
    order = ["item_id", "requested_at", "request_id"]
    cells.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_first, _ROWS).write.parquet(f"{root}/passed")
    rows = spark.read.schema(_ROWS).parquet(f"{root}/passed")
    decided = rows.where("accepted is not null").select("item_id", "request_id", "quantity", "accepted")

    # one row per partition at most
    open_rows = rows.where("accepted is null")
    slices = open_rows.groupBy("item_id", "part").agg(F.sum("quantity").alias("total"), F.min("quantity").alias("least"), F.max("stock").alias("stock")).orderBy("item_id", "part").collect()
    if not slices:
        return decided
    by_key: dict[int, list] = {}
    for s in slices:
        by_key.setdefault(s.item_id, []).append(s)
    known = F.broadcast(spark.createDataFrame([(k,) for k in by_key], "item_id bigint"))
    heads = {r.item_id: r.stock for r in rows.where("accepted is not null").join(known, "item_id").groupBy("item_id").agg(F.min("left").alias("stock")).collect()}
    keys = {k: _Key(heads.get(k, mine[0].stock), [(s.part, s.total, s.least) for s in mine]) for k, mine in by_key.items()}

    settled = []
    while blocked := [(k, part, key.stock) for k, key in keys.items() if (part := key.advance()) is not None]:
        path = f"{root}/settled-{len(settled)}"
        starts = F.broadcast(spark.createDataFrame(blocked, "item_id bigint, part int, stock bigint"))
        turn = open_rows.drop("stock").join(starts, ["item_id", "part"]).repartition("item_id").sortWithinPartitions(*order)
        turn.select(*_READ).mapInArrow(_blocked, _ROWS).write.parquet(path)
        part = spark.read.schema(_ROWS).parquet(path)
        for r in part.groupBy("item_id").agg(F.min("left").alias("left")).collect():  # one row per blocked key
            keys[r.item_id].stock = r.left
        settled.append(part.select("item_id", "request_id", "quantity", "accepted"))
    whole = F.broadcast(spark.createDataFrame([(k, part, ok) for k, key in keys.items() for part, ok in key.whole], "item_id bigint, part int, ok boolean"))
    wholes = open_rows.join(whole, ["item_id", "part"]).select("item_id", "request_id", "quantity", F.col("ok").alias("accepted"))
    out = decided.unionByName(wholes)
    for s in settled:
        out = out.unionByName(s)
    return out
