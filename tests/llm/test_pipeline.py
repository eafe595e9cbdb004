"""The pipeline's stages on a small folder against plain versions of what each has to do."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from stockspark.llm.common import work_dir  # noqa: E402
from tests.llm.brute import near, shingle_set  # noqa: E402

SPOKEN = {"en": "the house and garden with old trees near a river where people walk in summer", "de": "das haus und der garten mit alten bäumen am fluss wo menschen im sommer gehen"}


@pytest.fixture(scope="module")
def folder(spark):
    rng = random.Random(5)
    rows = []
    for d in range(60):
        lang = rng.choice(["en", "de"])
        words = SPOKEN[lang].split()
        base = [rng.choice(words) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(30, 90))]
        rows.append((d, " ".join(base), lang, rng.choice(["a", "b", None])))
        for _ in range(rng.choice([0, 0, 2])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((1000 + len(rows), " ".join(copy), lang, "a"))
    item = " ".join(f"question{i}" for i in range(20))
    rows += [(500, f"the house {item} the garden", "en", "b"), (501, None, "en", "a"), (502, "12 34 !", "en", "a"), (503, "", "de", None)]
    # one id, two texts: the second one is near to nothing; and a null id
    rows += [(0, "an entirely different text about trees and houses in the old river garden of the people", "en", "a"), (None, "a text without any id but with words of the house", "en", "b")]
    path = work_dir(spark, "pipeline-test")
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def _texts(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_every_stage_does_its_work_on_what_the_one_before_kept(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    spoken = stages["language_id"](spark, docs, path)
    assert spoken.columns == columns
    want = sorted((str(d), t) for d, t, *_ in rows if t and any(c.isalpha() for c in t))
    assert _texts(spoken) == want

    one = stages["minhash_near_dedup"](spark, spoken, path)
    assert one.columns == columns
    have = spoken.collect()
    groups = near([(i, r.text) for i, r in enumerate(have)], words=5, threshold=0.8)
    kept = _texts(one)
    by_group: dict = {}
    for i, _, component, _ in groups:
        by_group.setdefault(component, set()).add((str(have[i].doc_id), have[i].text))
    assert len(kept) == len(by_group) and all(sum(k in g for k in kept) == 1 for g in by_group.values())
    assert ("0", rows[-2][1]) in kept and ("None", rows[-1][1]) in kept

    clean = stages["benchmark_decontamination"](spark, one, path)
    assert clean.columns == columns
    item = next(r for r in spark.read.parquet(f"{path}/benchmark.parquet").collect() if r.text)
    asked = shingle_set(item.text, 5)
    assert _texts(clean) == [k for k in kept if len(asked & shingle_set(k[1], 5)) < 0.8 * len(asked)]
    assert len(_texts(clean)) < len(kept)

    mixed = stages["mix_sources"](spark, clean, path)
    assert mixed.columns == columns
    times: dict = {}
    for k in _texts(mixed):
        times[k] = times.get(k, 0) + 1
    assert set(times) <= set(_texts(clean)) and max(times.values()) <= 3

    got = stages["token_files"](spark, mixed, path).collect()
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = [(str(d), np.array([*lib.encode(t, add_special_tokens=False).ids, 0], dtype="<u4")) for d, t in _texts(mixed)]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((d, len(x), zlib.crc32(x)) for d, x in ids)


def test_run_goes_through_all_stages_and_takes_an_empty_table(spark, folder):
    path, _ = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 20
    empty = work_dir(spark, "pipeline-empty")
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_near_dedup_keeps_texts_where_they_are(spark, folder):
    """The kept rows are found without a shuffle of the texts, however many they are."""
    path, _ = folder
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan.split("Scan parquet")[0] and "SortMergeJoin" not in plan.split("Scan parquet")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
