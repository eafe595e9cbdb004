"""Shared helpers: work folders, word splitting and hashing on whole batches, and the packed exchange.

Packed exchange: a task groups its (key, value) arrays by ``key % buckets`` and ships one
binary cell per bucket, so Spark shuffles a few large rows instead of one row per word.
``buckets`` grows with the text, so what one task unpacks stays about the same size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that separates words: \x20 and \x09-\x0D (what bytes.split() takes too).
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_SPLIT = "[\\x20\\x09-\\x0D]+"

#: Text bytes that a task handles at once (a longer text is handled alone).
CHUNK_BYTES = 4 << 20
#: Text bytes per bucket of a packed exchange.
BUCKET_BYTES = 8 << 20

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
#: Spans are hashed by two polynomials modulo this prime (a power of two as modulus lets crafted sequences collide).
_PRIME = U64((1 << 31) - 1)
_BASES = (1_217_406_131, 1_842_307_969)
#: Words up to this length are hashed in steps of eight bytes for all words at once, longer ones one by one.
_STEPWISE_BYTES = 256
_BELOW = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], dtype=np.uint64)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder that the cluster names in spark.checkpoint.dir."""
    from stockspark.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str):
    """The column called ``name``, taken literally (dots in the name included)."""
    return F.col(f"`{name.replace('`', '``')}`")


#: Numbers that one bit map covers (as many as bitmap_construct_agg takes).
MAP_BITS = 1 << 15


def bit_maps(numbers: DataFrame) -> DataFrame:
    """(map, bits) of the column ``number``, whole numbers from 0 on (null: none): a bit for each, MAP_BITS of them a row."""
    # dealt by map first: a task then makes whole maps, not a nearly empty one of each
    placed = numbers.where("number is not null").select(F.shiftright("number", MAP_BITS.bit_length() - 1).alias("map"), F.col("number").bitwiseAND(MAP_BITS - 1).alias("at"))
    return placed.repartition("map").groupBy("map").agg(F.bitmap_construct_agg("at").alias("bits"))


def in_maps(rows: DataFrame, number: Column, maps: DataFrame) -> DataFrame:
    """The rows whose ``number`` has its bit set.  Only the maps are sent around, the rows stay where they are."""
    at = number.bitwiseAND(MAP_BITS - 1)
    byte = F.conv(F.hex(F.substring(maps["bits"], F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1
    return rows.join(F.broadcast(maps), (F.shiftright(number, MAP_BITS.bit_length() - 1) == maps["map"]) & bit, "left_semi")


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    """A prime number of buckets in proportion to the bytes of text (one aggregate over the table)."""
    total = docs.agg(F.sum(F.octet_length(column(docs, text)))).first()[0] or 0
    return prime_at_least(max(7, -(-total // BUCKET_BYTES)))


def prime_at_least(n: int) -> int:
    """The smallest prime >= n: ids in even steps still spread over that many shards."""
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1."""
    x = (x & _PRIME) + (x >> U64(31))
    x = (x & _PRIME) + (x >> U64(31))
    return x - _PRIME * (x >= _PRIME)


class _Powers:
    """Powers of the hash bases and of their inverses, kept and grown as needed."""

    up = np.ones((2, 1), dtype=np.uint64)
    down = np.ones((2, 1), dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while cls.up.shape[1] < n:
            have = cls.up.shape[1]
            for name, exponent in (("up", have), ("down", -have)):
                step = np.array([[pow(b, exponent, int(_PRIME))] for b in _BASES], dtype=np.uint64)
                table = getattr(cls, name)
                setattr(cls, name, np.concatenate((table, _modulo(table * step)), axis=1))
        return cls.up, cls.down


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums (two rows) from which span_hash takes the hash of any span of ``values``."""
    n = len(values)
    up, _ = _Powers.get(n + 1)
    out = np.zeros((2, n + 1), dtype=np.uint64)
    for row, part in enumerate((values & _PRIME, values >> U64(33))):
        out[row, 1:] = _modulo(np.cumsum(_modulo(part * up[row, :n])))
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the values in [start, end), by content and length only."""
    _, down = _Powers.get(prefix.shape[1])
    one, two = (_modulo(_modulo(row[end] + _PRIME - row[start]) * shift[start]) for row, shift in zip(prefix, down))
    return mix(((one << U64(31)) | two) ^ ((end - start).astype(np.uint64) * _P))


def word_hash(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end]; words of up to eight bytes and equal length never collide."""
    padded = np.frombuffer(data + bytes(8), dtype=np.uint8)
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    out = size.astype(np.uint64) * _P
    open_ = np.arange(len(start))
    for at in range(0, _STEPWISE_BYTES, 8):
        if not len(open_):
            break
        left = size[open_] - at
        block = eight[start[open_] + at] & _BELOW[np.minimum(left, 8)]
        out[open_] = mix(out[open_] ^ block)
        open_ = open_[left > 8]
    for i in open_.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """The words of several texts at once: hashes, and per text the range of its words."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts)
        if lower:
            joined = joined.lower()  # bytes.lower() changes A-Z only
        data = np.frombuffer(joined, dtype=np.uint8)
        space = _SPACE[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        if len(data):
            edge[0], edge[-1] = ~space[0], ~space[-1]
            np.not_equal(space[1:], space[:-1], out=edge[1:-1])
            at = np.flatnonzero(edge)
        else:
            at = np.zeros(0, dtype=np.int64)
        start, end = at[::2], at[1::2]
        self.hash = word_hash(joined, start, end)
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        begins = np.cumsum(sizes + 1) - sizes - 1
        #: words of text i are [first[i], first[i + 1])
        self.first = np.searchsorted(start, np.append(begins, len(data) + 1))
        self.count = np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Per word, the position of its text."""
        return np.repeat(np.arange(len(self.count)), self.count)


def text_chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``limit`` bytes of text (at least one row), texts as bytes (null: empty)."""
    for batch in batches:
        cells = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.cumsum(pc.fill_null(pc.binary_length(cells), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, stop - at), [x or b"" for x in cells.slice(at, stop - at).to_pylist()]
            at = stop


def int64(batch: pa.RecordBatch, name: str, null: int = np.iinfo(np.int64).min) -> np.ndarray:
    """A whole-number column as int64; nulls become ``null``."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.int64()), null).to_numpy(zero_copy_only=False)


#: Rows of a packed exchange: where it goes, where it came from, the packed arrays.
PACKED = "bucket int, origin int, data binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("origin", pa.int32()), ("data", pa.binary())])


def pack(bucket: np.ndarray, arrays: list[np.ndarray], origin: int = 0) -> pa.RecordBatch:
    """One row per bucket that occurs; its data holds the bucket's part of every array, one after another."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, dtype=np.int64)
    ends = np.append(starts[1:], len(bucket))
    arrays = [a[order] for a in arrays]
    data = [b"".join(a[s:e].tobytes() for a in arrays) for s, e in zip(starts.tolist(), ends.tolist())]
    return pa.record_batch([pa.array(bucket[starts].astype(np.int32)), pa.array(np.full(len(starts), origin, dtype=np.int32)), pa.array(data, type=pa.binary())], schema=_PACKED)


def unpack(cells: Iterable[bytes], kinds: list[np.dtype | str]) -> list[np.ndarray]:
    """The arrays of all cells, put together."""
    kinds = [np.dtype(k) for k in kinds]
    width = sum(k.itemsize for k in kinds)
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for cell in cells:
        n, at = len(cell) // width, 0
        for k, part in zip(kinds, parts):
            part.append(np.frombuffer(cell, dtype=k, count=n, offset=at))
            at += n * k.itemsize
    return [np.concatenate(part) if part else np.zeros(0, dtype=k) for k, part in zip(kinds, parts)]


def first_of_equal(*sorted_keys: np.ndarray) -> np.ndarray:
    """Positions where a new key begins in arrays that are sorted together."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def is_in(keys: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Which keys occur in the sorted array ``have``."""
    if not len(have):
        return np.zeros(len(keys), dtype=bool)
    return have[np.minimum(np.searchsorted(have, keys), len(have) - 1)] == keys


#: What a worker process remembers, by operator.
_MEMORY: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """The operator's memory in this worker; that of other operators is given up, so a worker holds one at a time."""
    if operator not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[operator] = {}
    return _MEMORY[operator]
