from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from stockspark.llm import topk_search
from stockspark.llm.mixing import _swap, mix_sources, targets
from stockspark.llm.topk_search import top_k


def vectors(seed=4, n=300, dim=6):
    rng = random.Random(seed)
    rows = [(i, [rng.choice((-1.0, 0.5, 0.25, rng.uniform(-1, 1))) for _ in range(dim)]) for i in range(n)]
    return rows + [(1000, None), (1050, [1.0, None]), (1100, [math.nan] * dim), (1150, [math.inf] * dim), (None, [1.0] * dim), (1200, [0.1, 0.2]), (1250, []), (7, [2.0] * dim)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "ROW_TILE", 10)
    monkeypatch.setattr(topk_search, "QUERY_TILE", 3)
    rows = vectors()
    got = sorted(map(tuple, top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()))
    good = [(i, np.floor(256 * np.array(np.float32(v), dtype=float)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, q in good:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_large_values_and_empty(spark):
    rows = [(0, [3e12, 1.0]), (1, [1e3, 2.0]), (2, [1e3, 3.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, scale=1).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(2, 3 * 10**15 + 3), (1, 3 * 10**15 + 2)]
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).collect() == []


def test_targets_reshare_the_excess():
    got = targets([("b", 10), ("a", 1000), (None, 10), ("c", 0)])
    assert got["a"] + got["b"] + got[None] == 1020 or all(got[k] <= 3 * n for k, n in (("a", 1000), ("b", 10), (None, 10), ("c", 0)))
    assert got["b"] == 30 and got["c"] == 0 and targets([]) == {}


def test_mix_meets_targets_and_repeats(docs_of):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 60))), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    rows += [(2000, "long " * 5000, "en", "a"), (2001, None, None, None), (None, "x y", None, "b"), (5, "x y z", None, "b"), (5, "x y z", None, "b")]
    df = docs_of(rows)
    one, two = (sorted((tuple(r[c] for c in ("doc_id", "size", "source_size", "target", "taken", "source")) for r in mix_sources(df).collect()), key=str) for _ in range(2))
    assert one == two and len(one) == len(rows)
    for name in ("a", "b", "c", None):
        mine = [r for r in one if r[5] == name]
        assert abs(sum(r[4] for r in mine) - mine[0][3]) <= 60 and sum(r[1] for r in mine) == mine[0][2]
        assert all(r[4] <= 3 * r[1] for r in mine)
    assert mix_sources(docs_of([])).collect() == []
    assert [r.taken for r in mix_sources(docs_of([(1, "a b", None, "s")]).withColumn("target", F.lit("x"))).collect()] == [2]


def test_null_columns_are_told_apart(docs_of):
    rows = [(1, None, None, "a"), (1, "a", None, None), (None, "a", None, "a"), (1, "a", None, "a")]
    got = [(r.doc_id, r.text, r.source) for r in mix_sources(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted([(d, t, s) for d, t, _, s in rows], key=str)


def test_landing_keeps_the_document_total():
    rng = np.random.default_rng(3)
    for _ in range(50):
        size = rng.integers(1, 200, 80).astype(float)
        p = (rng.random(80) < 0.4).astype(float)
        meant, before, n = float(p @ size) + rng.integers(-90, 90), p.copy(), p.sum()
        _swap(p, size, meant)
        assert p.sum() == n and abs(meant - p @ size) <= abs(meant - before @ size) and set(p) <= {0.0, 1.0}


def test_document_and_token_totals_of_every_source(docs_of):
    rng = random.Random(12)
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 80))), None, rng.choice(["a", "b", "c"])) for i in range(3000)]
    got = mix_sources(docs_of(rows)).collect()
    for name in "abc":
        mine = [r for r in got if r.source == name]
        expected = mine[0].target / mine[0].source_size
        assert abs(sum(r.copies for r in mine) - expected * len(mine)) <= 2
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 5
