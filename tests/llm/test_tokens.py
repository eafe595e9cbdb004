from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from stockspark.llm import encoders, token_files  # noqa: E402
from stockspark.llm.common import work_dir  # noqa: E402
from stockspark.llm.token_counts import prove_whole_tokens, token_counts  # noqa: E402
from stockspark.llm.token_files import read_tokens, token_digest, write_tokens  # noqa: E402

TEXTS = [
    "The quick brown fox, it's 3 o'clock; we'LL go.", "", None, "  two  spaces \n\n and\ttabs ", "a<|endoftext|>b <|startoftext|>", "ÀÉÎ œuvre straße İstanbul ǅ ª²¼",
    "日本語 テキスト and 한국어", "x" * 5000, "word " * 4000, "é combining, café", "nb sp  thin ​ zero", "\x00\x01 ctrl \x1c sep \x85 nel", "…“quotes”—dash ’s ’t", "don't DON'T 'S 's", "😀 emoji 👩‍👩‍👧", "a\r\nb\x0bc\x0cd", " lead", "trail ", "a \tb", "1234567 12,345.67",
]


@pytest.fixture(scope="module")
def rows():
    return [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again")]


def test_counts_equal_the_library(docs_of, rows):
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = sorted(map(tuple, token_counts(docs_of(rows), P.path("word_bpe_49k.json"), limit=100).collect()), key=str)
    n = [len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted(((d, len((t or "").encode()), k, k > 100) for (d, t), k in zip(rows, n)), key=str)
    assert token_counts(docs_of([]), P.path("word_bpe_49k.json")).collect() == []


def test_proven_strings_are_one_token():
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    proven = sorted(prove_whole_tokens(P.path("word_bpe_49k.json")))
    assert len(proven) > 10_000 and all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in proven[::50])


def test_files_round_trip(spark, docs_of, rows):
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4") for _, t in rows]
    got = token_digest(docs_of(rows), P.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted((d, len(x), zlib.crc32(x)) for (d, _), x in zip(rows, ids) if d is not None)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    path = work_dir(spark, "tokens-test")
    write_tokens(docs_of(rows), path, P.path("byte_bpe_50k.json"))
    back = {r.doc_id: r.ids for r in read_tokens(spark, path).where("doc_id in (0, 6)").collect()}
    assert back == {0: ids[0].tolist(), 6: ids[6].tolist()}
    assert token_digest(docs_of([]), P.path("byte_bpe_50k.json")).collect() == []


def test_counts_of_random_latin_text_equal_the_library(docs_of):
    """Capitals whose lower case lies outside the plain letters (and every other character of the range) in random strings."""
    rng = random.Random(6)
    characters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028))] + [" ", "\n"] * 40
    texts = ["åƊ", "åɄ", "ōȾ", "ÃȺ"] + ["".join(rng.choice(characters) for _ in range(rng.randint(1, 8))) for _ in range(20_000)]
    lib = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]
    got = {r.doc_id: r.n_tokens for r in token_counts(docs_of(list(enumerate(texts))), P.path("word_bpe_49k.json")).collect()}
    assert [t for i, t in enumerate(texts) if got[i] != want[i]] == []


def test_ids_of_random_text_equal_the_library(monkeypatch):
    monkeypatch.setattr(encoders, "BATCH_CHARS", 500)
    rng = random.Random(7)
    characters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250))] + [" "] * 150 + ["\n", "\t"] * 20
    texts = ["".join(rng.choice(characters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoder = encoders.Encoder(P.path("byte_bpe_50k.json"))
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        want = [x.ids for x in lib.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.batch(part)] == want


def test_clashing_columns_and_blocks_of_parts(docs_of, rows, monkeypatch):
    df = docs_of(rows).withColumnRenamed("lang", "part").withColumnRenamed("source", "ids").withColumnRenamed("n_chars", "n_tokens")
    digest = lambda d: sorted(map(tuple, token_digest(d, P.path("byte_bpe_50k.json")).collect()), key=str)
    counts = lambda d: sorted(map(tuple, token_counts(d, P.path("word_bpe_49k.json")).collect()), key=str)
    plain = digest(docs_of(rows))
    assert counts(df) == counts(docs_of(rows)) and digest(df) == plain
    monkeypatch.setattr(token_files, "PART_BYTES", 2000)
    monkeypatch.setattr(token_files, "BLOCK_PARTS", 2)
    assert digest(df) == plain
    monkeypatch.setattr(token_files, "BROADCAST_PARTS", 0)
    assert digest(df) == plain


class Watched:
    """A tokenizer that keeps what it is asked to encode."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode(self, text, **options):
        self.asked.append(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.asked.extend(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_words_are_encoded_once_whatever_stands_beside_them():
    encoder = encoders.Encoder(P.path("byte_bpe_50k.json"))
    encoder.tokenizer = Watched(encoder.tokenizer)
    encoder.batch([" alpaca bandicoot caracal dormouse", ", .\nalpaca\n!? 12 \tbandicoot caracal'd dormouse"])
    encoder.tokenizer.asked.clear()
    text = " alpaca, bandicoot.\nalpaca!? caracal12 dormouse\n\tbandicoot alpaca"
    assert encoder.ids(text).tolist() == encoder.tokenizer.tokenizer.encode(text).ids
    assert [w for w in ("alpaca", "bandicoot", "caracal", "dormouse") if w in "".join(encoder.tokenizer.asked)] == []


def test_a_remembered_piece_takes_few_bytes():
    encoder = encoders.Encoder(P.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    words = list({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(40_000)})
    tracemalloc.start()
    for at in range(0, len(words), 4000):
        encoder.batch([" ".join(words[at : at + 4000])])
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 100 * len(words)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_where_kinds_of_characters_meet_equal_the_library(name, monkeypatch):
    monkeypatch.setattr(encoders, "BATCH_CHARS", 300)
    monkeypatch.setattr(encoders, "KNOWN_PIECES", 2000, raising=False)
    monkeypatch.setattr(encoders, "LONGEST", 6, raising=False)
    rng = random.Random(9)
    parts = [*" \n\t\r'’-.,×÷²½ªµéÉ‐‧ǅ", " ", "  ", "\n\n", "ab", "s", "t", "re", "don't", "'ll", "'", "''", "9", "42", "\xa0", "\x85", " ", "\x1c", "\x00", "語", "<|endoftext|>", "<|endof", "text|>", "é", "😀"]
    texts = ["".join(rng.choices(parts, weights=[8] * (len(parts) - 14) + [1] * 14, k=rng.randint(0, 12))) for _ in range(6000)] + [" ", "\n", "  ", "\n\n", " \n", "", "a ", " a", "'s", "'", "ab" * 400]
    lib = tokenizers.Tokenizer.from_file(P.path(name))
    encoder = encoders.Encoder(P.path(name))
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        got = [x.tolist() for x in encoder.batch(part)]
        assert [(t, g) for t, g, w in zip(part, got, lib.encode_batch(part, add_special_tokens=False)) if g != w.ids] == []
