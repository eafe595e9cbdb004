from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from stockspark.llm.decontamination import contained_items, without_items  # noqa: E402
from stockspark.llm.language_id import Pieces, identify_languages, word_logs, words_of  # noqa: E402
from stockspark.llm.lm_scoring import build_segment, count_of, lm_scores, pair_probability, probe, quantised  # noqa: E402
from tests.llm.brute import crafted_words  # noqa: E402
from stockspark.llm.warc import base32_sha1, read_warc, work_dir, write_warc  # noqa: E402


def test_lm_base_equals_brute_force_and_both_paths_agree(docs_of):
    rows = [(i, f"The cat{i % 7} sat on the MAT and the dog{i % 3} ran") for i in range(200)] + [(300, None), (301, ""), (302, "unseen words only")]
    tokens = {d: (t or "").encode().lower().split() + [None] for d, t in rows}
    train: Counter = Counter()
    for d, w in tokens.items():
        if zlib.crc32(str(d).encode()) % 10:
            train.update(w)
    n, v = sum(train.values()), len(train)
    one = {r.doc_id: r for r in lm_scores(docs_of(rows)).collect()}
    two = {r.doc_id: r for r in lm_scores(docs_of(rows), broadcast_bytes=0).collect()}
    for d, w in tokens.items():
        want = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert abs(one[d].base_score - want) < 1e-6 and one[d].n_tokens == len(w) and one[d].train_tokens == n
        assert one[d].n_known == sum(x in train for x in w) and abs(one[d].score - two[d].score) < 1e-9
    held = [r for r in one.values() if r.held_out and r.doc_id < 200]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scores(docs_of([])).collect() == []


def test_filter_gives_levels_back():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 63, 5000, dtype=np.uint64), rng.integers(2, 500, 5000)
    seg = build_segment(keys, counts)
    bits = np.full(5000, seg[:8].view(np.uint64)[0])
    got = probe(seg[8:], np.zeros(5000, dtype=np.int64), bits, keys)
    assert (got >= quantised(counts)).all() and (got == quantised(counts)).mean() > 0.9
    other = probe(seg[8:], np.zeros(5000, dtype=np.int64), bits, rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert (other == 0).mean() > 0.9 and count_of(np.array([0]))[0] == 0


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0}])
def test_lm_pairs_seen_once_count_and_every_context_sums_to_one(docs_of, options):
    # "always" has one frequent follower, "rare" only followers seen once
    rows = [(i, f"always same rare word{i} end{i % 3}") for i in range(120)]
    tokens = {d: [None, *t.split(), None] for d, t in rows}
    kept = [w for d, w in tokens.items() if zlib.crc32(str(d).encode()) % 10]
    uni = Counter(x for w in kept for x in w[1:])
    pairs = Counter(p for w in kept for p in zip(w, w[1:]))
    floor = sum(uni.values()) + 0.1 * (len(uni) + 1)
    after = {v: [float(count_of(quantised(np.array([n])))[0]) for (x, _), n in pairs.items() if x == v] for v in uni}

    def prob(v, w):
        p, level = (uni[w] + 0.1) / floor, quantised(np.array([pairs[v, w]])) if pairs[v, w] else np.array([0])
        mass, followers = (sum(after[v]), len(after[v])) if v in after else (0, 0)
        return float(pair_probability(np.array([p]), level, np.array([float(mass)]), np.array([float(followers)]))[0])

    for v in [*uni, "never"]:
        assert abs(sum(prob(v, w) for w in uni) + prob(v, "never") - 1) < 1e-9
    assert all(prob("rare", w) > 2 * prob("always", w) for v, w in pairs if v == "rare")
    got = {r.doc_id: r.score for r in lm_scores(docs_of(rows), **options).collect()}
    for d, w in tokens.items():
        assert abs(got[d] - sum(math.log10(prob(*p)) for p in zip(w, w[1:]))) < 1e-6


def test_forward_sums_all_segmentations():
    pieces = Pieces(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(3)
    prob = rng.random((pieces.size + 1, 2)) / pieces.size
    place = dict(zip(pieces.keys.tolist(), pieces.ids.tolist()))

    def total(word):
        if not word:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(word) + 1):
            i = place.get(Pieces._key(word[:k]), -1 if k == 1 else None)
            if i is not None:
                out += prob[i] * total(word[k:])
        return out

    for word in ("the", "über", "日本", "qxz"):
        assert np.allclose(word_logs(pieces, [word], prob)[0], np.log(total("▁" + word)))


def test_language_held_out_and_edge_cases(docs_of):
    text = {"en": "the house and the garden with old trees", "de": "das haus und der garten mit alten bäumen"}
    rows = [(i, text["en" if i % 2 else "de"], "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "12 34 !?", "de"), (102, "garten und haus " * 3000, None), (None, "the trees", None)]
    got = {r.doc_id: r for r in identify_languages(docs_of(rows), P.path("piece_bpe_32k.model"), F.col("doc_id") % 5 != 0).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0 <= got[i].score <= 1 for i in range(60))
    assert (got[100].lang_pred, got[101].lang_pred, got[102].lang_pred, got[None].lang_pred) == ("und", "und", "de", "en")
    assert [r.lang_pred for r in identify_languages(docs_of([(1, "abc")]), P.path("piece_bpe_32k.model"), F.lit(True)).collect()] == ["und"]


def test_a_rare_language_is_learned_from_its_own_texts(docs_of):
    rows = [(i, "the house and the garden with old trees", "en") for i in range(3000)]
    rows += [(5000 + i, "das haus und der garten mit alten bäumen", "de") for i in range(8)]
    rows += [(6000, "der garten und das haus", None), (6001, "the garden and the house", None)]
    got = {r.doc_id: r.lang_pred for r in identify_languages(docs_of(rows), P.path("piece_bpe_32k.model"), F.lit(True), fit_docs=20).collect()}
    assert (got[5000], got[6000], got[6001], got[0]) == ("de", "de", "en", "en")


def test_containment(spark, docs_of):
    item = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, "start " + item.upper() + " end " * 500), (2, item.replace("six", "x")), (3, None), (4, "say hello world again"), (5, "hello"), (None, item), (6, item), (6, item)]
    items = spark.createDataFrame([(7, item), (8, "Hello World"), (9, None), (10, " "), (None, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in contained_items(docs_of(rows), items).collect())
    assert got == [(1, 7, 8, 8), (4, 8, 1, 1), (6, 7, 8, 8)]
    assert sorted(str(r.doc_id) for r in without_items(docs_of(rows), items).collect()) == ["2", "3", "5", "None"]
    assert contained_items(docs_of([]), items).collect() == [] and contained_items(docs_of(rows), items.limit(0)).collect() == []


def test_warc_round_trip(spark):
    rows = [(i, f"http://x.org/{i}\n", f"<p>{i % 5}</p>" * (i % 5 * 50)) for i in range(40)] + [(100, None, None), (101, "u", ""), (None, "v", "z" * 100_000), (7, "http://x.org/7\n", "<p>2</p>" * 100)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = work_dir(spark, "warc-test")
    manifest = write_warc(df, root, roll_bytes=2000, shard_bytes=5000)
    back = read_warc(manifest, root, with_payload=True).collect()
    newest: dict = {}
    for p, _, h in rows:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if p is None else p)
    want = []
    for p, _, h in rows:
        to = newest[h or ""]
        revisit = p is not None and p < to
        want.append((p, len(h or ""), base32_sha1((h or "").encode()), "revisit" if revisit else "response", to if revisit else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=str) == sorted(want, key=str)
    assert all(r.payload.decode() in newest for r in back if r.record_type == "response")
    again = write_warc(df, work_dir(spark, "warc-test"), roll_bytes=2000, shard_bytes=5000)
    names = sorted((r.name, r.sha1) for r in manifest.collect())
    assert len(names) > 3 and names == sorted((r.name, r.sha1) for r in again.collect())
    assert write_warc(df.limit(0), work_dir(spark, "warc-test")).collect() == []


def test_letters_are_letters_and_marks_stay_inside_words(docs_of):
    rows = [(i, ("the house and the garden", "das haus und der garten")[i % 2], ("en", "de")[i % 2]) for i in range(40)]
    rows += [(100, "½ ² ① Ⅷ _ 3", None), (101, "\u0301\u0300", None), (102, "the ½ house", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs_of(rows), P.path("piece_bpe_32k.model"), F.lit(True)).collect()}
    assert got[100] == got[101] == ("und", 0.0) and got[102][0] == "en"
    assert words_of("नमस्ते, दुनिया e\u0301t\u0301 x²y") == ["नमस्ते", "दुनिया", "e\u0301t\u0301", "x", "y"]


def test_crafted_words_are_different_tokens(docs_of):
    one, two = crafted_words()
    got = {r.doc_id: r for r in lm_scores(docs_of([(d, one) for d in range(30)] + [(d, two) for d in (1000, 1001)])).collect()}
    trained = sum(zlib.crc32(str(d).encode()) % 10 != 0 for d in range(30))
    n = got[0].train_tokens
    assert abs(got[0].base_score - got[1000].base_score) > 0.5 and n >= 2 * trained
