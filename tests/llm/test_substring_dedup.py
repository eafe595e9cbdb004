from __future__ import annotations

import random

import numpy as np
from tests.llm.brute import crafted_words, substring

from stockspark.llm.common import Words
from stockspark.llm.substring_dedup import substring_dedup, window_anchors


def result(df, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, **options).collect()), key=str)


def texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(10, " ".join(base)), (11, "\t".join(base)), (12, " ".join(base[100:220]))]
    near = list(base)
    near[150] = "edit"
    rows += [(13, "\n".join(near)), (14, "a " * 300), (15, "x " + "a " * 120 + "y"), (16, "a b " * 80), (17, "b " + "a b " * 70)]
    rows += [(18, None), (19, ""), (20, " \t "), (21, "short text"), (22, "é" * 5000), (None, " ".join(base)), (10, " ".join(base)), (10, " ".join(base[50:150]))]
    for d in range(30, 60):
        own = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        at = rng.randint(0, len(own))
        cut = rng.randint(0, 340)
        rows.append((d, " ".join(own[:at] + base[cut : cut + rng.randint(40, 60)] + own[at:])))
    return rows


def test_equals_brute_force(docs_of):
    rows = texts()
    assert result(docs_of(rows), buckets=7) == sorted(substring(rows), key=str)


def test_short_window_and_many_repeats(docs_of):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    assert result(docs_of(rows), window=6, buckets=11) == sorted(substring(rows, 6), key=str)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(9)
    base = [rng.choice("abcdefgh") for _ in range(200)]
    words = Words([" ".join(x + base + y).encode() for x, y in (([], []), (["p", "q"], ["r"]), (["a"] * 9, ["h"] * 9))])
    anchor, starts, _ = window_anchors(words, 50)
    first, offset = words.first, (0, 2, 9)
    rows = [anchor[first[i] + offset[i] : first[i] + offset[i] + 151] for i in range(3)]
    assert np.array_equal(rows[0], rows[1]) and np.array_equal(rows[0], rows[2]) and len(starts)


def test_empty_table_and_clashing_columns(docs_of):
    assert result(docs_of([])) == []
    df = docs_of([(1, "a b c d")]).withColumnRenamed("lang", "shard").withColumnRenamed("source", "bucket")
    assert result(df)[0][:3] == (1, 4, 0)


def test_crafted_words_and_sequences_stay_different(docs_of):
    one, two = crafted_words()
    shared = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{shared} {one}"), (2, f"{shared} {two}"), (3, " ".join(one)), (4, " ".join(two)), (5, f"{shared} {one}")]
    assert result(docs_of(rows)) == sorted(substring(rows), key=str)


def test_word_hashes_follow_the_word_alone():
    rng = random.Random(4)
    words = ["".join(rng.choice("abé😀") for _ in range(n)) for n in (1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 255, 256, 257, 300, 5000) for _ in range(3)]
    a = Words([" ".join(words).encode()]).hash
    b = Words([w.encode() for w in words] + [b"", b"  "]).hash
    assert a.tolist() == b.tolist() and len(set(a.tolist())) == len(set(words))
