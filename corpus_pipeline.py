"""Corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; run()
writes each stage's rows as Parquet to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import bit_maps, in_maps, stored
from stockspark.llm.decontamination import without_items
from stockspark.llm.language_id import identify_languages
from stockspark.llm.mixing import mix_sources
from stockspark.llm.near_dedup import near_duplicates
from stockspark.llm.queries import BYTE_VOCABULARY, PIECE_VOCABULARY, held_out, table, vocabulary
from stockspark.llm.token_files import token_digest


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a text or letters go."""
    found = identify_languages(docs, vocabulary(PIECE_VOCABULARY), ~held_out(docs), carry=True)
    return found.where("lang_pred <> 'und'").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group.

    Every row is a document of its own, whatever its doc_id: rows that share an id but not their
    text are told apart, and rows with a null id take part.  The row numbers are written first; the numbers
    kept come back as a bit each, so the texts are not shuffled to find them.
    """
    row = next(n for n in (f"row_{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = near_duplicates(numbered, words=5, threshold=0.8, doc_id=row).where("kept").select(F.col("doc_id").alias("number"))
    return in_maps(numbered, numbered[row], bit_maps(kept)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return without_items(docs, table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times)."""
    mixed = mix_sources(docs).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents as token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_digest(docs, vocabulary(BYTE_VOCABULARY), end_id=0)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mix_sources", mixing),
    ("token_files", token_files),
]

#: Segmentation likelihoods, cube sampling and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
