"""Names taken and given up within one batch: rounds equal the sequential loop."""

from __future__ import annotations

import random

from stockspark.operators import changes as E
from stockspark.plans import timeline
from stockspark.plans.ordering import next_change
from stockspark.plans.timeline import settle_names

from .conftest import D


def one_by_one(before, wants):
    """Sequence numbers of the granted requests; before: [(id, key)], wants: [(seq, id, key)]."""
    has, granted = dict(before), []
    for seq, row, key in sorted(wants):
        if not any(k == key for i, k in has.items() if i != row):
            has[row] = key
            granted.append(seq)
    return granted, has


def rounds(spark, before, wants):
    holders = spark.createDataFrame(before, "id bigint, key string")
    df = spark.createDataFrame(wants, "seq bigint, id bigint, key string")
    return sorted(r.seq for r in settle_names(holders, df).collect())


CASES = {
    "duplicate within the batch": ([(1, "a"), (2, "b")], [(1, 1, "x"), (2, 2, "x")]),
    "freed name": ([(1, "a"), (2, "b")], [(1, 1, "x"), (2, 2, "a")]),
    "not yet freed": ([(1, "a"), (2, "b")], [(1, 2, "a"), (2, 1, "x")]),
    "swap through a third name": ([(1, "a"), (2, "b")], [(1, 1, "t"), (2, 2, "a"), (3, 1, "b")]),
    "direct swap fails": ([(1, "a"), (2, "b")], [(1, 1, "b"), (2, 2, "a")]),
    "own name again": ([(1, "a")], [(1, 1, "a"), (2, 1, "a"), (3, 1, "b"), (4, 1, "a")]),
    "two rows with one name": ([(1, "a"), (2, "a"), (3, "c")], [(1, 1, "a"), (2, 1, "b"), (3, 3, "a"), (4, 2, "d"), (5, 3, "a")]),
    "chain": ([(i, f"n{i}") for i in range(6)], [(10 - i, i, f"n{i + 1}") for i in range(5)] + [(1, 5, "free")]),
    "blocked chain": ([(i, f"n{i}") for i in range(6)], [(10 - i, i, f"n{i + 1}") for i in range(6)] + [(1, 5, "n0")]),
    "nothing": ([(1, "a")], []),
}


def _random_case(seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(7)]
    before = [(i, rng.choice([*names, f"own{i}"])) for i in range(9)]
    return before, [(seq * 3, rng.randint(0, 8), rng.choice([*names, *names, f"own{seq}"])) for seq in range(60)]


def test_settles_like_the_loop(spark):
    """All cases in one batch, each with rows and names of its own."""
    cases = {**CASES, **{f"random {seed}": _random_case(seed) for seed in range(12)}}
    before, wants, want = [], [], set()
    for n, (had, asked) in enumerate(cases.values()):
        before += [(100 * n + i, f"{n}:{k}") for i, k in had]
        wants += [(1000 * n + seq, 100 * n + i, f"{n}:{k}") for seq, i, k in asked]
        want |= {(n, seq) for seq in one_by_one(had, asked)[0]}
    random.Random(9).shuffle(wants)
    got = {divmod(seq, 1000) for seq in rounds(spark, before, wants)}
    names = list(cases)
    assert {names[n]: seq for n, seq in got ^ want} == {}
    assert rounds(spark, before, []) == []


def test_hot_name_and_hot_row_need_few_rounds(spark, monkeypatch):
    turns = []
    monkeypatch.setattr(timeline, "next_change", lambda *a: turns.append(1) or next_change(*a))
    before = [(i, f"n{i}") for i in range(50)]
    wants = [(i, i % 50, "hot") for i in range(1000)]  # all ask for one name, its holder again and again
    wants += [(2000 + i, 3, f"free{i // 2}") for i in range(400)]  # one row asks 400 times
    assert rounds(spark, before, wants) == one_by_one(before, wants)[0]
    assert len(turns) <= 4


def test_next_change_over_partitions(spark):
    rng = random.Random(2)
    rows = [(1 if o % 5 else o % 7 + 2, o, "a" if 200 < o < 700 else rng.choice("ab")) for o in range(900)]
    got = {r.o: r.n for r in next_change(spark.createDataFrame(rows, "k long, o long, v string"), "k", "o", "v", ["o", "v"], "n").collect()}
    after: dict = {}
    for k, o, v in reversed(rows):
        runs = after.setdefault(k, [])  # first rows of the runs behind, nearest last
        if runs and runs[-1][1] == v:
            runs.pop()
        assert (got[o] and tuple(got[o])) == (runs[-1] if runs else None)
        runs.append((o, v))


def test_category_update_in_order(spark, frames):
    cats = frames.categories([{"id": 1, "name": "Tools"}, {"id": 2, "name": "Pumps"}, {"id": 3, "name": "Valves"}])
    rows = [(1, 1, "Same"), (2, 2, " same "), (3, 3, "TOOLS"), (4, 9, "x1"), (5, 2, "  "), (6, 1, "Last"), (7, 2, "same")]
    req = spark.createDataFrame([(*r, "d") for r in rows], "seq bigint, id bigint, name string, description string")
    res = E.category_update(cats, req)
    assert {r.id: r.name for r in res.snapshot.collect()} == {1: "Last", 2: "same", 3: "TOOLS"}
    assert sorted((r.seq, r.reason) for r in res.rejects.collect()) == [(2, "duplicate_name"), (4, "not_found"), (5, "invalid_name")]


def test_inventory_update_refuses_whole_requests(spark, frames):
    from stockspark.sources.requests import INVENTORY_NEW_COLS, _nulls

    inv = frames.inventory([{"id": i, "name": n, "quantity": 1, "unit_price": D(1)} for i, n in ((1, "A"), (2, "B"), (3, "C"))])
    rows = [(1, 1, ["name"], "X", None), (2, 2, ["name", "quantity"], "x", 9), (3, 3, ["name", "quantity"], " a ", 7), (4, 2, ["quantity"], None, 5)]
    req = spark.createDataFrame(rows, "seq bigint, id bigint, fields array<string>, new_name string, new_quantity int")
    res = E.inventory_update(inv, _nulls(req, INVENTORY_NEW_COLS), "2024-02-01 00:00:00")
    assert {r.id: (r.name, r.quantity) for r in res.snapshot.collect()} == {1: ("X", 1), 2: ("B", 5), 3: ("a", 7)}
    assert [(r.seq, r.reason) for r in res.rejects.collect()] == [(2, "duplicate_name")]
