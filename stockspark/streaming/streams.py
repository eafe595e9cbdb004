"""Structured Streaming jobs (S1, S2) over a file source.

S1 ``sale_post_stream``: sale requests arrive as Parquet files; every
micro-batch runs the batch sale posting (E9), once, against the stock as the
batches before left it.  The stock is a base table plus one small folder of
changed items per batch: a batch writes what it sold, not the inventory.
Every ``compact_every`` batches a new base is written.  Which base and which
changes a batch reads follows from its number alone, and it overwrites its own
folders, so a replayed batch gives the same files: the at-least-once
``foreachBatch`` sink becomes effectively exactly-once.

S2 ``daily_sales_stream``: per-day revenue and count.  In append mode, with a
watermark and 1-day tumbling windows, a day is emitted once the watermark
passes its end: days still open at the end and rows later than the watermark
are not in the output (that is the meaning of this mode and of the key
``daily_sales_stream``).  With ``open_days`` it is an additive ledger: every
batch writes its own sums per day in a folder of its own and
``read_daily_sales`` adds them up.  No row is ever too late, no state is kept,
and a replayed batch overwrites its folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators.changes import sale_post
from ..schemas import INVENTORY, SALES

SALE_REQUEST_SCHEMA = T.StructType([
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


#: Batches after which the changes are merged into a new base.
COMPACT_EVERY = 16

_CHANGED = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("batch", T.LongType()),
])


def _base_path(state_dir: str, version: int) -> str:
    return os.path.join(state_dir, "stock", "base", f"v={version}")


def _changes_path(state_dir: str) -> str:
    return os.path.join(state_dir, "stock", "changes")


def init_stock_state(inventory: DataFrame, state_dir: str) -> None:
    """Write the starting stock: base 0."""
    inventory.write.mode("overwrite").parquet(_base_path(state_dir, 0))


def read_stock(spark: SparkSession, state_dir: str, version: int | None = None, compact_every: int = COMPACT_EVERY) -> DataFrame:
    """The inventory before batch ``version`` (None: after the last batch that wrote changes).

    The base of that time, with the newest of the changes since for each item.
    """
    if version is None:
        version = spark.read.schema(_CHANGED).parquet(_changes_path(state_dir)).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0] + 1
    since = version - version % compact_every
    base = spark.read.schema(INVENTORY).parquet(_base_path(state_dir, since))
    if since == version:
        return base
    changes = spark.read.schema(_CHANGED).parquet(_changes_path(state_dir)).where(F.col("batch").between(since, version - 1))
    newest = changes.groupBy("id").agg(F.max_by(F.struct("quantity", "updated_at"), "batch").alias("n"))
    return changed_stock(base, newest.select("id", "n.quantity", "n.updated_at"))


def start_sale_post_stream(
    spark: SparkSession,
    requests_dir: str,
    state_dir: str,
    checkpoint: str,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    compact_every: int = COMPACT_EVERY,
) -> StreamingQuery:
    """Run sale posting for every micro-batch of request files.

    Outputs: ``state_dir/outcomes/batch=N`` (request_id, item_id, status),
    ``state_dir/sales/batch=N`` (accepted), ``state_dir/stock`` (see
    ``read_stock``).  An item is updated at the time of its last sale.
    """
    reader = spark.readStream.schema(SALE_REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    requests = reader.parquet(requests_dir)

    def process(batch: DataFrame, batch_id: int) -> None:
        bs = batch.sparkSession
        own = f"batch={batch_id}"
        stock = read_stock(bs, state_dir, batch_id, compact_every)
        res = sale_post(stock, batch)
        res.extra["outcomes"].write.mode("overwrite").parquet(os.path.join(state_dir, "outcomes", own))
        sold_path = os.path.join(state_dir, "sales", own)
        res.extra["accepted"].write.mode("overwrite").parquet(sold_path)
        # the changes follow from the sales just written: nothing is posted twice
        sold = bs.read.schema(SALES).parquet(sold_path).groupBy(F.col("item_id").alias("id")).agg(
            F.sum("quantity").alias("_sold"), F.max("sale_date").alias("updated_at")
        )
        changed = sold.join(stock.select("id", "quantity"), "id").select("id", (F.col("quantity") - F.col("_sold")).cast("int").alias("quantity"), "updated_at")
        changed.write.mode("overwrite").parquet(os.path.join(_changes_path(state_dir), own))
        if (batch_id + 1) % compact_every == 0:
            merged = changed_stock(stock, bs.read.schema(_CHANGED).parquet(os.path.join(_changes_path(state_dir), own)))
            merged.write.mode("overwrite").parquet(_base_path(state_dir, batch_id + 1))

    writer = requests.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def changed_stock(stock: DataFrame, changed: DataFrame) -> DataFrame:
    """``stock`` with the quantity and time of the ``changed`` items (one row per item)."""
    now = changed.select("id", F.struct("quantity", "updated_at").alias("_now"))
    cols = [F.when(F.col("_now").isNotNull(), F.col(f"_now.{c}")).otherwise(F.col(c)).alias(c) if c in ("quantity", "updated_at") else F.col(c) for c in stock.columns]
    return stock.join(now, "id", "left").select(*cols)


def read_outcomes(spark: SparkSession, state_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(state_dir, "outcomes")).drop("batch")


def daily_sales(sales: DataFrame, watermark: str = "1 day") -> DataFrame:
    """S2 plan: per-day revenue and count over a (streaming) sales frame.

    ``withWatermark`` needs TIMESTAMP (with zone), so the zone-less sale_date
    is cast first (session zone UTC keeps the wall-clock day).
    """
    ts = sales.withColumn("_ts", F.col("sale_date").cast(T.TimestampType()))
    return (
        ts.withWatermark("_ts", watermark)
        .groupBy(F.window("_ts", "1 day"))
        .agg(S.money_sum("total_price").alias("revenue"), F.count(F.lit(1)).alias("sales_count"))
        .select(F.to_date(F.col("window.start")).alias("date"), "revenue", "sales_count")
    )


def start_daily_sales_stream(
    spark: SparkSession,
    sales_dir: str,
    output_dir: str,
    checkpoint: str,
    watermark: str = "1 day",
    state_partitions: int | None = None,
    open_days: bool = False,
) -> StreamingQuery:
    """Append closed days to Parquet under ``output_dir``; with ``open_days`` keep the ledger of all days there.

    The state of the append mode holds one row per open day, so it needs few
    partitions; their number is fixed when the query first starts (Spark keeps
    it in the checkpoint).  Default: the session's default parallelism.  The
    query runs in a session of its own, whose settings other work never sees.
    The ledger needs neither state nor ``watermark``.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")  # day windows are UTC days
    sales = own.readStream.schema(SALES).parquet(sales_dir)

    def book(batch: DataFrame, batch_id: int) -> None:
        days = batch.where("sale_date is not null").groupBy(F.to_date("sale_date").alias("date"))
        sums = days.agg(S.money_sum("total_price").alias("revenue"), F.count(F.lit(1)).alias("sales_count"))
        sums.write.mode("overwrite").parquet(os.path.join(output_dir, f"batch={batch_id}"))

    if open_days:
        return sales.writeStream.foreachBatch(book).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    own.conf.set("spark.sql.shuffle.partitions", str(state_partitions or spark.sparkContext.defaultParallelism))
    writer = daily_sales(sales, watermark).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.outputMode("append").format("parquet").option("path", output_dir).start()


def read_daily_sales(spark: SparkSession, output_dir: str) -> DataFrame:
    """The ledger of the ``open_days`` stream: the sums of all batches per date."""
    booked = spark.read.parquet(output_dir).groupBy("date")
    return booked.agg(S.money_sum("revenue").alias("revenue"), F.sum("sales_count").alias("sales_count"))
