"""Substring search over stored tables with a trigram index.

The index says which three-letter pieces (of the lower-case text) occur in which file of a table,
per column: one row per column, piece and file, written beside the table.  A search takes the
pieces of the literal parts of its pattern, keeps the files that hold all of them in one of the
searched columns, reads only those and applies the exact test there.  Patterns without three
letters in a row say nothing about files: then all are read.

What reaches the driver is a list of files.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _pieces(text: Column) -> Column:
    """Distinct three-letter pieces of the lower-case text."""
    low = F.lower(text)
    # a sequence from 1 to less than 1 would count down
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))))


def write_index(spark: SparkSession, table_path: str, columns: list[str], index_path: str) -> None:
    """Index ``columns`` of the Parquet table at ``table_path``; sorted by piece, so a search reads few row groups."""
    table = spark.read.parquet(table_path).select(*columns, F.col("_metadata.file_path").alias("file"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _pieces(F.col(c)).alias("pieces")) for c in columns])).alias("x")
    postings = table.select("file", cells).select("file", "x.column", F.explode("x.pieces").alias("piece")).distinct()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    postings.repartitionByRange(width, "piece").sortWithinPartitions("piece").write.mode("overwrite").parquet(index_path)


def literal_parts(pattern: str) -> list[str]:
    """The stretches of a LIKE pattern (backslash escapes) without wildcards."""
    plain = re.findall(r"(?:\\.|[^\\%_])+", pattern, re.S)
    return [re.sub(r"\\(.)", r"\1", p, flags=re.S) for p in plain]


def candidate_files(spark: SparkSession, index_path: str, columns: list[str], parts: list[str]) -> list[str] | None:
    """Files that may hold all ``parts`` in one of ``columns``; None where the parts are too short to tell."""
    low = spark.range(1).select(F.array(*[F.lower(F.lit(p)) for p in parts]).alias("p")).first().p if parts else []
    wanted = sorted({p[i : i + 3] for p in low for i in range(len(p) - 2)})
    if not wanted:
        return None
    found = spark.read.parquet(index_path).where(F.col("piece").isin(*wanted) & F.col("column").isin(*columns))
    full = found.groupBy("column", "file").agg(F.count_distinct("piece").alias("n")).where(F.col("n") == len(wanted))
    return sorted(r.file for r in full.select("file").distinct().collect())


def search(spark: SparkSession, table_path: str, index_path: str, columns: list[str], term: str, like: bool = True) -> DataFrame:
    """Rows of the table of which one of ``columns`` contains ``term``, in any case.

    With ``like`` the wildcards % and _ in ``term`` count, as in ILIKE '%term%'; without, it is plain text.
    """
    schema = spark.read.parquet(table_path).schema
    pattern = f"%{term}%"
    files = candidate_files(spark, index_path, columns, literal_parts(pattern) if like else [term])
    if files is None:
        rows = spark.read.schema(schema).parquet(table_path)
    elif files:
        rows = spark.read.schema(schema).parquet(*files)
    else:
        return spark.createDataFrame([], schema)
    hits = [F.col(c).ilike(pattern) if like else F.contains(F.lower(F.col(c)), F.lower(F.lit(term))) for c in columns]
    return rows.where(F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), hits), F.lit(False)))
