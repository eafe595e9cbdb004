"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.chat_format import format_turns, read_back, turns_of_json, turns_of_table
from stockspark.llm.chat_repair import damaged, repaired
from stockspark.llm.decontamination import contained_items
from stockspark.llm.language_id import identify_languages
from stockspark.llm.lm_scoring import lm_scores
from stockspark.llm.mixing import mix_sources
from stockspark.llm.near_dedup import near_duplicates
from stockspark.llm.oracles import ORACLES
from stockspark.llm.substring_dedup import substring_dedup
from stockspark.llm.token_counts import token_counts
from stockspark.llm.token_files import token_digest
from stockspark.llm.topk_search import top_k
from stockspark.llm.warc import warc_digest
from stockspark.llm.whitening import whiten, whole_vectors

#: Vocabulary files; their places are parameters of the operators.
WORD_VOCABULARY, BYTE_VOCABULARY, PIECE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), window=50, with_text=False).drop("kept")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), limit=2048)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_digest(table(spark, sf_dir, "pages"), min_bytes=0)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), end_id=0)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, threshold=0.8)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), modulus=10)


def held_out(docs: DataFrame):
    """The fold that language identification does not learn from."""
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, vocabulary(PIECE_VOCABULARY), ~held_out(docs))
    return found.select("doc_id", F.coalesce(held_out(found), F.lit(False)).alias("held_out"), "lang_pred", "score")


#: A conversation whose texts hold control strings, added to the table as a record of another layout.
CONTROL_STRINGS = r"\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = json.dumps({"messages": [{"role": role, "content": CONTROL_STRINGS} for role in ("user", "assistant")]})
    added = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(messages).alias("json"))
    turns = turns_of_table(table(spark, sf_dir, "conversations")).unionByName(turns_of_json(added))
    return read_back(format_turns(turns))


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repaired(conversations, damaged(conversations))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(whole_vectors(table(spark, sf_dir, "embeddings"), scale=256), components=4)


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_warc": op4_warc,
    "op5_exact_topk": op5_exact_topk,
    "op6_token_files": op6_token_files,
    "op7_mix_sources": op7_mix_sources,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_language_id": op10_language_id,
    "op11_chat_format": op11_chat_format,
    "op12_chat_repair": op12_chat_repair,
    "op13_embedding_whitening": op13_embedding_whitening,
}

__all__ = ["ORACLES", "QUERIES"]
