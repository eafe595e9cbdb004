"""Embedding whitening: exact integer scatter by bit slices.

Entries become integers. A task takes blocks of distinct vectors, shifts every dimension to start
at 0 and packs each bit of it across the rows of a block into 64-bit words, one bit plane per
dimension and bit. The number of ones in the AND of two planes, weighted by the planes' places,
adds up to the exact cross-product of two dimensions; the shift is then taken back. Spark sums
the blocks' products (as limbs of 32 bits, so no sum overflows) to one row per pair of
dimensions: all that reaches the driver is that table, whose size depends on the number of
dimensions alone. The covariance is centred in whole numbers before the one division.

Defined cases: rows with a null vector, or with null or non-finite entries, take no part, nor do
empty vectors; vectors of different lengths are whitened each among those of their own length;
repeated vectors are fitted once and all returned; entries beyond 64 bits are cut to 64 bits;
directions without variance have a null ``whitened`` and explain 0 and are not in
``identity_error``; a ``deviation`` beyond 64 bits is null, ``deviation_wide`` has it as text;
a null id is an id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.llm.common import column

#: Rows of one block of bit planes.
BLOCK_ROWS = 1 << 14
#: Bytes of bit planes compared at once.
TILE_BYTES = 8 << 20
#: Limbs of 32 bits of a sum: 192 bits hold any sum of products of 64-bit entries.
LIMBS = 6
#: Eigenvalues below this part of the largest are no direction.
RANK = 1e-12


def whole_vectors(table: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", scale: int = 256) -> DataFrame:
    """(vec_id, x): floor(scale * entry) as whole numbers, rows without such a vector left out."""
    cells = F.transform(column(table, vector), lambda c: c.cast("double"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform("v", lambda c: F.floor(c * F.lit(float(scale))).cast("bigint"))
    kept = table.select(column(table, vec_id).alias("vec_id"), cells.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & good)
    return kept.select("vec_id", x.alias("x"))


# ------------------------------------------------------------------ bit-sliced products
def planes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(bit planes [dims, bits, words], shift of each dimension, bits) of whole numbers [rows, dims]."""
    low = block.min(axis=0)
    shifted = (block - low).astype(np.uint64)  # wraps to the right value also where the span passes 63 bits
    bits = max(1, int(shifted.max()).bit_length())
    rows, dims = block.shape
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words), dtype=np.uint64)
    for b in range(bits):
        ones = np.zeros((dims, words * 64), dtype=np.uint8)
        ones[:, :rows] = ((shifted >> np.uint64(b)) & np.uint64(1)).T
        out[:, b] = np.packbits(ones, axis=1).view(np.uint64)
    return out, low, bits


def products(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact (sum of x_i x_j, sum of x_i) over the rows of a block, as Python integers."""
    rows, dims = block.shape
    sliced, low, bits = planes(block)
    flat = sliced.reshape(dims * bits, -1)
    ones = np.bitwise_count(flat).sum(axis=1, dtype=np.int64).reshape(dims, bits)
    place = np.array([1 << b for b in range(bits)], dtype=object)
    sums = ones.astype(object) @ place
    cross = np.zeros((dims, dims), dtype=object)
    # counts are below the rows of a block: products of short entries fit 64 bits
    short = 2 * bits + rows.bit_length() < 62
    weight = place.astype(np.int64) if short else place
    step = max(1, TILE_BYTES // max(1, flat.nbytes))
    for i in range(dims):
        for b in range(0, bits, step):
            part = sliced[i, b : b + step]
            counts = np.bitwise_count(flat[i * bits :, None, :] & part[None]).sum(axis=2, dtype=np.int64)
            counts = counts.reshape(dims - i, bits, -1)
            counts = counts if short else counts.astype(object)
            cross[i, i:] += np.einsum("dbk,b,k->d", counts, weight, weight[b : b + step]) if short else (counts * weight[None, :, None] * weight[None, None, b : b + step]).sum(axis=(1, 2))
    lower = np.tril_indices(dims, -1)
    cross[lower] = cross.T[lower]
    low = low.astype(object)
    cross = cross + np.outer(low, sums) + np.outer(sums, low) + rows * np.outer(low, low)
    return cross, sums + rows * low


_FIELDS = ["dims", "i", "j", *[f"l{k}" for k in range(LIMBS)]]
PARTS = ", ".join(f"{c} bigint" for c in _FIELDS)
_PARTS = pa.schema([(c, pa.int64()) for c in _FIELDS])


def _limbs(value: int) -> list[int]:
    """The value as signed limbs: sums of limbs are the limbs of the sum."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    return [sign * ((value >> 32 * k) & 0xFFFFFFFF) for k in range(LIMBS)]


def _scatter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct vectors -> per pair of dimensions the task's product sums; row (-1, -1) counts, rows (-1, j) are sums."""
    total: dict[int, list] = {}
    waiting: dict[int, list] = {}

    def take(dims: int) -> None:
        block = np.concatenate(waiting.pop(dims))
        cross, sums = products(block)
        have = total.setdefault(dims, [np.zeros((dims, dims), dtype=object), np.zeros(dims, dtype=object), 0])
        have[0] += cross
        have[1] += sums
        have[2] += len(block)

    for batch in batches:
        cells = batch.column(0)
        sizes = np.diff(cells.offsets.to_numpy())
        values = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        for dims in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dims)
            for at in range(0, len(rows), BLOCK_ROWS):
                mine = rows[at : at + BLOCK_ROWS]
                waiting.setdefault(dims, []).append(values[starts[mine][:, None] + np.arange(dims)])
                if sum(map(len, waiting[dims])) >= BLOCK_ROWS:
                    take(dims)
    for dims in list(waiting):
        take(dims)
    for dims, (cross, sums, n) in total.items():
        out = [(dims, -1, -1, *_limbs(n)), *((dims, -1, j, *_limbs(int(sums[j]))) for j in range(dims))]
        out += [(dims, i, j, *_limbs(int(cross[i, j]))) for i in range(dims) for j in range(i, dims)]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)], schema=_PARTS)


@dataclass(frozen=True)
class Fit:
    """Whitening of the vectors of one length."""

    n: int
    sums: np.ndarray  # Python integers
    directions: np.ndarray  # [components, dims], unit eigenvectors
    values: np.ndarray  # eigenvalues, falling
    explained: np.ndarray
    identity_error: float | None


def fit_of(n: int, sums: np.ndarray, cross: np.ndarray, components: int) -> Fit:
    centred = n * cross - np.outer(sums, sums)  # whole numbers
    covariance = np.array([[int(x) / (n * n) for x in row] for row in centred], dtype=float)  # one rounding each
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    values, directions = values[order], vectors[:, order].T
    trace = sum(int(centred[i, i]) for i in range(len(sums))) / (n * n)
    real = values > max(0.0, RANK * float(values[0]))
    if real.any():
        scaled = directions[real] / np.sqrt(values[real])[:, None]
        error = float(np.abs(scaled @ covariance @ scaled.T - np.eye(int(real.sum()))).max())
    else:
        error = None
    return Fit(n, sums, directions, np.where(real, values, 0.0), np.where(real, values, 0.0) / trace if trace else np.zeros(len(values)), error)


def fits(vectors: DataFrame, components: int = 4) -> dict[int, Fit]:
    """A fit per vector length, over distinct vectors."""
    parts = vectors.select("x").distinct().mapInArrow(_scatter, PARTS)
    rows = parts.groupBy("dims", "i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    by: dict[int, dict] = {}
    for r in rows:  # dims * (dims + 1) / 2 + dims + 1 rows for each length
        by.setdefault(r.dims, {})[r.i, r.j] = sum(r[3 + k] << 32 * k for k in range(LIMBS))
    out = {}
    for dims, cells in by.items():
        cross = np.array([[cells[min(i, j), max(i, j)] for j in range(dims)] for i in range(dims)], dtype=object)
        out[dims] = fit_of(cells[-1, -1], np.array([cells[-1, j] for j in range(dims)], dtype=object), cross, components)
    return out


# ------------------------------------------------------------------ apply
WHITENED = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_wide string"
_WHITENED = pa.schema([
    ("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()),
    ("explained", pa.float64()), ("identity_error", pa.float64()), ("deviation_wide", pa.string()),
])


def _deviations(x: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S as doubles over n, exact squared lengths of n x - S) of rows of one length."""
    reach = max(abs(int(x.max())), abs(int(x.min()))) * fit.n + max(abs(int(s)) for s in fit.sums)
    if reach * reach * x.shape[1] < 1 << 63:
        away = x * fit.n - fit.sums.astype(np.int64)
        return away / fit.n, (away * away).sum(axis=1)
    away = x.astype(object) * fit.n - fit.sums
    return (away / fit.n).astype(float), (away * away).sum(axis=1)


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_wide) of (vec_id, x)."""
    found = fits(vectors, components)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells = batch.column(0), batch.column(1)
            sizes = np.diff(cells.offsets.to_numpy())
            values = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes).tolist():
                fit, rows = found[dims], np.flatnonzero(sizes == dims)
                x = values[starts[rows][:, None] + np.arange(dims)]
                away, squares = _deviations(x, fit)
                k = len(fit.values)
                with np.errstate(divide="ignore", invalid="ignore"):
                    white = (away @ fit.directions.T) / np.sqrt(fit.values)
                flat = np.tile(fit.values > 0, len(rows))
                whole = [int(s) for s in squares for _ in range(k)]
                wide = any(s >= 1 << 63 for s in whole[::k])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(rows, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(whole), fit.n, dtype=np.int64)),
                        pa.array([s if s < 1 << 63 else None for s in whole] if wide else whole, type=pa.int64()),
                        pa.array(white.reshape(-1), mask=~flat),
                        pa.array(np.tile(fit.explained, len(rows))),
                        pa.array([fit.identity_error] * len(whole), type=pa.float64()),
                        pa.array([str(s) for s in whole], type=pa.string()),
                    ],
                    schema=_WHITENED,
                )

    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "x").mapInArrow(run, WHITENED)
