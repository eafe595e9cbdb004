from __future__ import annotations

import random

import numpy as np

from stockspark.llm import near_dedup
from stockspark.llm.common import bit_maps, in_maps
from stockspark.llm.components import connected_components
from stockspark.llm.near_dedup import estimate, near_duplicates, packed_bits, shingle_sets, signatures
from tests.llm.brute import crafted_words, near, shingle_set


def result(df, **options):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, **options).collect()), key=str)


def rows(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out, d = [], 0
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.choice((1, 2, 25))):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((d, (" " if d % 2 else "\n").join(copy).upper() if d % 3 else " ".join(copy)))
            d += 1
    out += [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "one two three"), (905, "É a b c"), (906, "é a b c"), (907, " "), (908, "a " * 3000), (909, "a a a a a")]
    return out


def test_equals_brute_force(docs_of):
    data = rows()
    assert result(docs_of(data), words=4) == sorted(near(data, 4), key=str)
    assert result(docs_of(data)) == sorted(near(data, 5), key=str)


def test_estimate_is_corrected_for_chance():
    rng = random.Random(2)
    a = [f"x{rng.random()}" for _ in range(4000)]
    b = a[:3000] + [f"y{i}" for i in range(1000)]
    shingle, bounds = shingle_sets([" ".join(t).encode() for t in (a, b)], 1)
    bits = packed_bits(signatures(shingle, bounds))
    assert abs(float(estimate(bits[0], bits[1])) - 0.6) < 0.25


def test_repeated_null_and_empty(docs_of):
    data = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g"), (3, None)]
    got = result(docs_of(data))
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (None, 3, None, True)], key=str)
    assert result(docs_of([])) == []
    assert result(docs_of([(5, "")])) == [(5, 0, 5, True)]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 7), (60, 61), (61, 62), (5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 0, **dict.fromkeys((60, 61, 62), 60)}
    assert np.sum([1 for _ in got]) == 45


def test_crafted_words_are_not_linked_and_columns_may_clash(docs_of):
    one, two = crafted_words()
    data = [(1, one), (2, two), (3, one), (4, " ".join(one)), (5, " ".join(two))]
    df = docs_of(data).withColumnRenamed("lang", "doc").withColumnRenamed("source", "print").withColumnRenamed("n_chars", "bits")
    assert result(df, words=4) == sorted(near(data, 4), key=str)


def test_texts_just_below_the_threshold_give_no_pair_rows(docs_of, monkeypatch):
    """A group in which hardly a pair is similar enough: its pairs do not leave the task that compares them."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    data = []
    for d in range(150):
        copy = list(base)
        for at in rng.sample(range(150), 3):
            copy[at] = f"x{rng.random()}"
        data.append((d, " ".join(copy)))
    data += [(500 + d, text + " tail") for d, text in data[:5]]
    written: dict = {}
    keep = near_dedup.stored

    def counted(df, name):
        out = keep(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    assert result(docs_of(data), words=4) == sorted(near(data, 4), key=str)
    assert written["links"] < 155 and max(written["pairs"], written.get("candidates", 0)) < len(data) ** 2 // 4


def test_bit_maps_hold_exactly_their_numbers(spark):
    numbers = [0, 7, 8, 32767, 32768, 65535, (1 << 33) + 5, None]
    rows = spark.createDataFrame([(i, "x") for i in [*numbers, 1, 6, 9, 32766, 32769, 1 << 33]], "bits long, map string")
    maps = bit_maps(spark.createDataFrame([(n,) for n in numbers], "number long"))
    got = in_maps(rows, rows["bits"], maps)
    assert got.columns == ["bits", "map"]
    assert sorted(r.bits for r in got.collect()) == [n for n in numbers if n is not None]


def _half_alike(n=60):
    """Texts that share bands although hardly one of them is near to another, and a few near copies."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    data = []
    for d in range(n):
        copy = list(base)
        for at in rng.sample(range(120), 12):
            copy[at] = f"x{rng.random()}"
        data.append((d, " ".join(copy)))
    return [*data, (None, data[0][1]), *((500 + d, text + " tail") for d, text in data[:5])]


def test_results_do_not_depend_on_how_partners_are_found(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", -1)
    for data in (rows(), _half_alike()):
        assert result(docs_of(data), words=4) == sorted(near([r for r in data if r[0] is not None], 4) + [(None, len(shingle_set(t, 4)), None, True) for d, t in data if d is None], key=str)


def test_sets_and_signatures_move_only_where_a_pair_needs_them(docs_of, monkeypatch):
    data = _half_alike()
    written: dict = {}
    keep = near_dedup.stored

    def noted(df, name):
        out = keep(df, name)
        written.setdefault(name, []).append((out.columns, out.count()))
        return out

    monkeypatch.setattr(near_dedup, "stored", noted)
    result(docs_of(data), words=4)
    assert sum(n for _, n in written["members"]) > 2 * len(data)
    assert all(not {"bits", "keys"} & set(columns) for columns, _ in written["members"])
    # the first steps join the near copies; the other texts share bands but no pair of them may reach the threshold
    assert sum(n for _, n in written["shingles"]) < len(data) // 4
