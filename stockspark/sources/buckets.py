"""Tables bucketed and sorted by id, so that write jobs on them move only their requests.

A bucketed table keeps rows of one hash of the id in one file, sorted.  A join on the id then
shuffles the requests into the same buckets and merges; the table itself is read in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import checkpoint_dir

#: Rows that one task sorts (about 200 MB of a sales table).
BUCKET_ROWS = 1 << 20


def bucketed(df: DataFrame, key: str = "id", buckets: int | None = None, name: str | None = None) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``key`` below the shared folder and return the stored table.

    ``buckets``: by default the session's shuffle partitions, so that requests meet it without a
    second shuffle, and more for a large table (one for every BUCKET_ROWS rows, counted first), as
    a bucket is sorted by one task and should not spill.  Rows are dealt by the same hash first,
    which gives one file per bucket; Spark then takes the files' order for the join as well.
    """
    spark = df.sparkSession
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // BUCKET_ROWS))
    name = name or f"bucketed_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/stockspark/buckets/{name}"
    writer = df.repartition(n, key).sortWithinPartitions(key).write.mode("overwrite").format("parquet")
    writer.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)
