from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockspark.llm import whitening as wh

EMB = "vec_id long, embedding array<float>"


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def check(rows, got, components=4):
    """Compares with exact fractions and numpy's eigenvectors."""
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)]
    by: dict = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    want_rows = 0
    for dims in {len(x) for _, x in kept}:
        mine = [(i, x) for i, x in kept if len(x) == dims]
        fit = sorted({tuple(x) for _, x in mine})
        n, sums = len(fit), [sum(c) for c in zip(*fit)]
        cov = np.array([[float(Fraction(n * sum(v[i] * v[j] for v in fit) - sums[i] * sums[j], n * n)) for j in range(dims)] for i in range(dims)])
        values = np.sort(np.linalg.eigvalsh(cov))[::-1]
        want_rows += len(mine) * min(components, dims)
        for i, x in mine:
            dev = sum((n * a - s) ** 2 for a, s in zip(x, sums))
            for c in range(1, min(components, dims) + 1):
                r = next(r for r in by[i, c] if r.deviation_wide == str(dev) and r.n == n)
                assert r.deviation == (dev if dev < 1 << 63 else None)
                assert r.explained == pytest.approx(max(values[c - 1], 0) / np.trace(cov) if np.trace(cov) else 0, rel=1e-6, abs=1e-9)
    assert len(got) == want_rows
    return kept


def test_equals_exact_covariance(spark, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK_ROWS", 37)
    monkeypatch.setattr(wh, "TILE_BYTES", 200)
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1 + d) for d in range(7)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [(5, rows[5][1])]  # copies are fitted once
    rows += [(2000, None), (2001, [1.0, None]), (2002, [math.nan] * 7), (2003, [math.inf] + [0.0] * 6), (2004, []), (None, [0.5] * 7), (2005, [-0.0] * 7)]
    df = spark.createDataFrame(rows, EMB).withColumn("x", F.lit("clash")).withColumn("dims", F.lit(1)).repartition(6)
    got = wh.whiten(wh.whole_vectors(df)).collect()
    kept = check(rows, got)
    assert max(r.identity_error for r in got) < 1e-9
    first = {}
    for r in got:
        first.setdefault(r.vec_id, {})[r.component] = r.whitened
    points = {tuple(x): [first[i][c] for c in range(1, 5)] for i, x in kept}
    w = np.array(list(points.values()))
    assert np.allclose(np.cov(w.T, bias=True), np.eye(4), atol=1e-9) and np.allclose(w.mean(axis=0), 0, atol=1e-9)
    x = np.array(list(points), dtype=float)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    for c in range(4):
        plain = (x - x.mean(axis=0)) @ vectors[:, -1 - c] / math.sqrt(values[-1 - c])
        assert np.allclose(w[:, c], plain, atol=1e-8) or np.allclose(w[:, c], -plain, atol=1e-8)


def test_products_of_any_size_are_exact():
    rng = random.Random(2)
    for bits in (1, 5, 30, 62):
        block = np.array([[rng.randint(-(1 << bits), 1 << bits) for _ in range(4)] for _ in range(70)], dtype=np.int64)
        cross, sums = wh.products(block)
        plain = block.astype(object)
        assert (cross == plain.T @ plain).all() and (sums == plain.sum(axis=0)).all()
    edge = np.array([[np.iinfo(np.int64).min, np.iinfo(np.int64).max], [np.iinfo(np.int64).max, 0]], dtype=np.int64)
    cross, _ = wh.products(edge)
    assert (cross == edge.astype(object).T @ edge.astype(object)).all()
    assert all(sum(x << 32 * k for k, x in enumerate(wh._limbs(v))) == v for v in (0, -1, 3 << 100, -(5 << 150)))


def test_no_variance_mixed_lengths_and_empty(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (4, [1.0, 5.0, 3.0]), (5, [3.0e38, -3.0e38, 0.0])]
    got = wh.whiten(wh.whole_vectors(spark.createDataFrame(rows[:4], EMB))).collect()
    check(rows[:4], got)
    still = [r for r in got if r.vec_id in (1, 2)]
    assert all(r.whitened is None and r.explained == 0 and r.identity_error is None for r in still)
    line = {r.component: r for r in got if r.vec_id == 3}
    assert abs(line[1].whitened) == pytest.approx(1) and line[2].whitened is None and line[1].explained == pytest.approx(1)
    big = wh.whiten(wh.whole_vectors(spark.createDataFrame(rows, EMB))).where("vec_id = 5").collect()
    assert len(big) == 3 and all(r.deviation is None and len(r.deviation_wide) > 19 for r in big)
    assert wh.whiten(wh.whole_vectors(spark.createDataFrame([], EMB))).collect() == []
