"""Benchmark decontamination: size-partitioned MinHash containment search.

An item with n distinct shingles is contained in a document when at least ceil(t * n) of
them occur there, so at most n - ceil(t * n) are missing.  Its sketch is its bottom-k
MinHash with k one larger than that: whatever the document's length, a document that
contains the item holds one of these k minima.  Items are partitioned by shingle length
(items of fewer words are one shingle as long as themselves) and size; a document is probed
with its hashes up to the partition's largest minimum, and only if it has enough shingles.
Candidates are verified by exact shingle containment.

Only DataFrame functions are used.  Words are split at \\x20 and \\x09-\\x0D, case is ignored.
Null or empty items and texts match nothing; rows with a null id take no part; rows of one
id count as one document (its best row); empty tables give an empty result; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import WORD_SPLIT, column

#: Sketch rows (24 bytes each) up to which the sketch is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000
_RESULT = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_SPLIT), lambda w: w != "")


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once per row, also inside the lambdas of ``use``."""
    return F.get(F.transform(F.array(value), use), 0)


def _hashes(text: Column, n: int) -> Column:
    """Distinct hashes of the n-word shingles; null for fewer words."""
    return _let(_words(text), lambda w: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n)))))))


def _shingles(text: Column, n: int) -> Column:
    return _let(_words(text), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", F.slice(w, i + 1, n)))))


def contained_items(docs: DataFrame, items: DataFrame, words: int = 5, threshold: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every item whose shingles a document contains to ``threshold``."""
    spark = docs.sparkSession
    d = docs.select(column(docs, doc_id).cast("long").alias("doc_id"), column(docs, text).alias("t")).where("doc_id is not null and t is not null")
    it = items.select(column(items, item_id).cast("long").alias("item_id"), column(items, text).alias("t"), F.least(F.size(_words(column(items, text))), F.lit(words)).alias("n")).where("item_id is not null and n > 0")
    found = spark.createDataFrame([], _RESULT)
    for n in sorted(r["n"] for r in it.select("n").distinct().collect()):  # at most ``words`` lengths
        part = it.where(F.col("n") == n)
        need = F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9)
        sketch = part.select("item_id", F.array_sort(_hashes(F.col("t"), n)).alias("h")).withColumn("n_item", F.size("h"))
        sketch = sketch.withColumn("need", need).withColumn("h", F.slice("h", 1, F.col("n_item") - F.col("need") + 1))
        # size partition: items of similar size share the least number of shingles that a document must have
        sketch = sketch.select("item_id", F.floor(F.log2("n_item")).alias("size_part"), "need", F.explode("h").alias("h"))
        bounds = sketch.agg(F.count("*").alias("rows"), F.max("h").alias("top"), F.min("need").alias("least")).first()
        # (shingles of the document, those that can be in a sketch), in one pass over its words
        low = _let(_hashes(F.col("t"), n), lambda h: F.struct(F.size(h).alias("n_doc"), F.filter(h, lambda x: x <= bounds["top"]).alias("h")))
        probe = d.select("doc_id", low.alias("low")).where(F.col("low.n_doc") >= bounds["least"])
        probe = probe.select("doc_id", F.col("low.n_doc").alias("n_doc"), F.explode("low.h").alias("h"))
        least = sketch.groupBy("size_part").agg(F.min("need").alias("least"))
        sketch = sketch.join(F.broadcast(least), "size_part").select("item_id", "least", "h")  # a row per power of two
        pairs = probe.join(F.broadcast(sketch) if bounds["rows"] <= BROADCAST_ROWS else sketch, "h").where("n_doc >= least").select("doc_id", "item_id").distinct()
        item_sets = part.select("item_id", _shingles(F.col("t"), n).alias("item_set"))
        doc_sets = d.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("t").alias("doc_text"))
        both = pairs.join(item_sets, "item_id").join(doc_sets, "doc_id").where(F.size(_words(F.col("doc_text"))) >= n)
        both = both.select("doc_id", "item_id", F.size(F.array_intersect("item_set", _shingles(F.col("doc_text"), n))).cast("long").alias("n_shared"), F.size("item_set").cast("long").alias("n_item"))
        both = both.where(F.col("n_shared") >= need).groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
        found = found.unionByName(both.withColumn("containment", F.col("n_shared") / F.col("n_item")))
    return found


def without_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents that contain no item; rows with a null id stay."""
    found = contained_items(docs, items, doc_id=doc_id, **options).select(F.col("doc_id").alias("found_id")).distinct()
    return docs.join(found, column(docs, doc_id) == F.col("found_id"), "left_anti")
