"""Exact top-k by integer inner product: tiled matrix products and tree-merged top lists.

Vectors are packed into tiles.  Every tile of rows meets every tile of queries (a join on
the number of the query tile, not of rows); a matrix product scores the two tiles, a partial
selection keeps the k best per query, and the lists are merged in rounds of FAN tiles until
one list per query is left.

Components are floor(scale * x).  Products are exact: tiles go through float64 where no sum
can reach 2**53, else through Python integers (beyond 64 bits
scores stop at the largest number).  Vectors that are null or hold a null or
non-finite component, and rows with a null id, take no part; only vectors of equal length
are compared; of repeated ids each row is a candidate, and no row meets its own id; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import column

#: Vectors of one tile of queries, and of one tile of rows.
QUERY_TILE, ROW_TILE = 2048, 4096
#: Lists merged at once.
FAN = 16
TILE = "dim int, tile long, ids binary, data binary"
LISTS = "dim int, q long, tile long, ids binary, best binary, score binary"


def _tiles(vectors: DataFrame, rows: int) -> DataFrame:
    """Pack (vec_id, v array<long>) rows into tiles of about ``rows`` vectors; a tile's number comes from the ids."""

    def build(table: pa.Table) -> pa.Table:
        dim, tile = table.column("dim")[0].as_py(), table.column("tile")[0].as_py()
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        data = np.asarray(table.column("v").combine_chunks().flatten().to_numpy(), dtype=np.int64).reshape(len(ids), dim)
        return pa.table([pa.array([dim], pa.int32()), pa.array([tile], pa.int64()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([data[order].tobytes()], pa.binary())], names=["dim", "tile", "ids", "data"])

    count = vectors.groupBy("dim").agg(F.count("*").alias("n"))
    number = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / rows))
    return vectors.join(count, "dim").select("dim", number.alias("tile"), "vec_id", "v").groupBy("dim", "tile").applyInArrow(build, TILE)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if q.size and x.size and float(np.abs(q.astype(float)).max()) * float(np.abs(x.astype(float)).max()) * q.shape[1] < 2.0**53:
        return np.rint(q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


def _select(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per line the k best, ties to the smaller id; missing candidates have id -1 at the end."""
    if score.shape[1] > k:
        # everything that reaches the k-th score, then the exact order among it
        edge = np.partition(score, -k, axis=1)[:, -k]
        line, col = np.nonzero(score >= edge[:, None])
    else:
        line, col = np.nonzero(np.ones_like(score, dtype=bool))
    value, name = score[line, col], (ids[col] if ids.ndim == 1 else ids[line, col])
    real = value != _NONE
    line, value, name = line[real], value[real], name[real]
    order = np.lexsort((name, -value, line))
    line, value, name = line[order], value[order], name[order]
    rank = np.arange(len(line)) - np.searchsorted(line, line)
    top = rank < k
    best = np.full((len(score), k), -1, dtype=np.int64)
    out = np.full((len(score), k), _NONE, dtype=np.int64)
    best[line[top], rank[top]], out[line[top], rank[top]] = name[top], value[top]
    return best, out


_NONE = np.iinfo(np.int64).min


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row for which ``is_query`` holds."""
    flag = table.select(column(table, vec_id).cast("long").alias("vec_id"), column(table, vector).alias("x"), F.coalesce(is_query, F.lit(False)).alias("query"))
    good = F.col("x").isNotNull() & F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
    value = F.transform("x", lambda e: F.floor(e.cast("double") * scale).cast("long"))
    vectors = flag.where(good).select("vec_id", "query", F.size("x").alias("dim"), value.alias("v"))
    queries = _tiles(vectors.where("query"), QUERY_TILE).select("dim", F.col("tile").alias("q"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    rows = _tiles(vectors, ROW_TILE)

    def partial(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["data"], dtype=np.int64).reshape(-1, r["dim"])
                q_ids, q = np.frombuffer(r["q_ids"], dtype=np.int64), np.frombuffer(r["q_data"], dtype=np.int64).reshape(-1, r["dim"])
                score = _scores(q, x)
                score[q_ids[:, None] == ids[None, :]] = _NONE
                best, value = _select(score, ids, k)
                yield pa.RecordBatch.from_pylist([{"dim": r["dim"], "q": r["q"], "tile": r["tile"], "ids": r["q_ids"], "best": best.tobytes(), "score": value.tobytes()}], schema=_LISTS)

    def merge(t: pa.Table) -> pa.Table:
        lists = t.to_pylist()
        lists.sort(key=lambda r: r["tile"])
        best, value = (np.concatenate([np.frombuffer(r[n], dtype=np.int64).reshape(-1, k) for r in lists], axis=1) for n in ("best", "score"))
        best, value = _select(value, best, k)
        return pa.Table.from_pylist([{**lists[0], "tile": lists[0]["tile"] // FAN, "best": best.tobytes(), "score": value.tobytes()}], schema=_LISTS)

    def unfold(batches):
        for batch in batches:
            for r in batch.to_pylist():
                q = np.repeat(np.frombuffer(r["ids"], dtype=np.int64), k)
                best, value = np.frombuffer(r["best"], dtype=np.int64), np.frombuffer(r["score"], dtype=np.int64)
                rank, real = np.tile(np.arange(1, k + 1, dtype=np.int32), len(q) // k), value != _NONE
                yield pa.record_batch([pa.array(q[real]), pa.array(rank[real]), pa.array(best[real]), pa.array(value[real])], names=["query_id", "rank", "vec_id", "score"])

    lists = rows.join(queries, "dim").repartition(F.col("dim"), F.col("q"), F.col("tile")).mapInArrow(partial, LISTS)
    tiles = -(-max([0, *(r["n"] for r in vectors.groupBy("dim").count().agg(F.max("count").alias("n")).collect() if r["n"])]) // ROW_TILE)
    while tiles > 1:
        lists = lists.withColumn("part", F.floor(F.col("tile") / FAN)).groupBy("dim", "q", "part").applyInArrow(lambda t: merge(t.drop(["part"])), LISTS)
        tiles = -(-tiles // FAN)
    return lists.mapInArrow(unfold, "query_id long, rank int, vec_id long, score long")


_LISTS = pa.schema([("dim", pa.int32()), ("q", pa.int64()), ("tile", pa.int64()), ("ids", pa.binary()), ("best", pa.binary()), ("score", pa.binary())])
