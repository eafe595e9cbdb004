"""Token ids in Parquet: one list column, sorted by doc_id, with small pages and page indexes.

Files hold doc_id, n_tokens, the place of the document among its file's ids, and the ids.
Row groups and pages have set sizes, ids are dictionary encoded, and the writer keeps
min/max and offsets per page, so a reader of one document or of the counts alone opens few
pages.  ``read_tokens`` gives each document's place among all ids from the counts of the
parts; ids are read only where they are asked for.

A null or empty text gives only the end id; a null doc_id sorts first; repeated rows are
kept each; an empty table gives empty files; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockspark.llm.common import column, text_chunks, work_dir
from stockspark.llm.encoders import encoder as shared_encoder

#: Bytes of text of a part, which is one task and one file.
PART_BYTES = 16 << 20
#: Parts whose totals are summed in one window.
BLOCK_PARTS = 4096
#: Parts whose offsets are broadcast (16 bytes each); beyond that Spark joins them.
BROADCAST_PARTS = 1 << 20
#: Characters of text whose pieces a task holds at once.
CHUNK_BYTES = 1 << 20
#: Bytes of a row group and of a page.
ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10
FILE_SCHEMA = "part int, doc_id long, n_tokens long, offset long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every text, append end_id, and write the ids in ascending doc_id order below ``path``."""
    rows = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))

    def encode(batches):
        from pyspark import TaskContext

        encoder, offset, part_no = shared_encoder(vocabulary), 0, TaskContext.get().partitionId()
        for part, texts in text_chunks(batches, limit=CHUNK_BYTES):
            ids, n_ids = encoder.flat(texts)
            size, ended = n_ids + 1, np.insert(ids, np.cumsum(n_ids), end_id)
            bounds = np.concatenate(([0], np.cumsum(size)))
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ended))
            yield pa.record_batch([pa.array(np.full(len(size), part_no, dtype=np.int32)), part.column("doc_id"), pa.array(size), pa.array(offset + bounds[:-1]), listed], names=["part", "doc_id", "n_tokens", "offset", "ids"])
            offset += int(bounds[-1])

    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    writer = ordered.mapInArrow(encode, FILE_SCHEMA).write
    writer.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.enable.dictionary", "true").option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; columns that are not used are not read."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # one small row per part; sums inside blocks of parts, and one row per block before them
    block = F.floor(F.col("part") / BLOCK_PARTS).alias("block")
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total")).withColumn("block", block)
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = totals.groupBy("block").agg(F.sum("total").alias("total"))
    before = blocks.select("block", F.coalesce(F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    base = totals.join(before, "block").select("part", (F.col("before") + F.coalesce(F.sum("total").over(inside), F.lit(0))).alias("base"))
    if totals.count() <= BROADCAST_PARTS:
        base = F.broadcast(base)
    return files.join(base, "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def _checksums(batches):
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("ids"))
        values = ids.flatten().to_numpy().astype("<u4", copy=False)
        bounds = np.concatenate(([0], np.cumsum(np.diff(ids.offsets.to_numpy()))))
        crc = [zlib.crc32(values[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.record_batch([*(batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, vocabulary: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the token files to a new shared folder, read them back: doc_id, start, n_tokens, ids_crc32."""
    path = work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id, doc_id, text)
    return read_tokens(docs.sparkSession, path).mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
