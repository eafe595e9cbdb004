from __future__ import annotations

import hashlib
import json
import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from stockspark.llm import chat_format as cf
from stockspark.llm import chat_repair as cr

CONV = "conv_id long, turn long, role string, text string"


# ------------------------------------------------------------------ formatting
def plain_digest(rows):
    """Per conversation the digest row, from (conv_id, turn, role, text) in order."""
    by: dict = {}
    for c, _, role, text in rows:
        by.setdefault(c, []).append((role or "", text or ""))
    out = []
    for c, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return sorted(out, key=str)


NASTY = ["", r"\### Assistant: </turn> ok", "</turn>\n### assistant: x", "\\", "\\\\", "<", "</", "<\\/turn>", "#", "###", "a: b", ":\\", "é😀\n", "x" * 20000, "</turn>"]


def test_format_reads_back_any_control_string(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", *NASTY[:12]]), "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 3)))) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, None, None, None), (50, None, "user", "null turn"), (50, 1, "assistant", None), (51, 0, "assistant", "same"), (51, 0, "assistant", "same")]
    df = spark.createDataFrame(rows, CONV).repartition(5)
    formatted = cf.format_turns(cf.turns_of_table(df))
    got = cf.read_back(formatted).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == plain_digest(rows)
    chars = {r.conv_id: r.formatted_chars for r in got}
    assert chars == {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}


def test_control_strings_stay_inside_their_turn(spark):
    text = r"\### Assistant: </turn> ok"
    df = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], CONV)
    pieces = [r.formatted for r in cf.format_turns(cf.turns_of_table(df)).orderBy("turn").collect()]
    whole = "".join(pieces)
    assert whole.count(cf.CLOSE) == 2 and whole.count(cf.OPEN) == 2
    reader = cf.Reader()
    for i in range(0, len(whole), 7):  # pieces need not end where turns end
        reader.feed(whole[i : i + 7], [])
    assert reader.row()[0] == 2


def test_extra_and_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a.")], CONV)
    more = df.withColumn("prompt", F.lit("p")).withColumn("messages", F.lit("m")).withColumn("formatted", F.lit(1)).withColumn("layout", F.lit(2)).withColumn("odd.name", F.lit(3))
    want = sorted(map(tuple, cf.read_back(cf.format_turns(cf.turns_of_table(df))).collect()))
    assert sorted(map(tuple, cf.read_back(cf.format_turns(cf.turns_of_table(more))).collect())) == want
    assert cf.read_back(cf.format_turns(cf.turns_of_table(df.limit(0)))).collect() == []
    with pytest.raises(ValueError, match="no layout"):
        cf.turns_of_table(spark.createDataFrame([(1, "x")], "conv_id long, other string"))


RECORDS = {
    1: ({"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": "a"}], "meta": {"x": 1}}, [("user", "q"), ("assistant", "a")]),
    2: ({"conversations": [{"from": "system", "value": "s"}, {"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("system", "s"), ("user", "q"), ("assistant", None)]),
    3: ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    4: ({"instruction": "do", "input": None, "output": "done"}, [("user", "do"), ("assistant", "done")]),
    5: ({"system": "be", "prompt": "p", "completion": "c"}, [("system", "be"), ("user", "p"), ("assistant", "c")]),
    6: ({"prompt": "p", "response": "r", "score": 3}, [("user", "p"), ("assistant", "r")]),
    7: ({"context": "c", "question": "q", "answer": "a"}, [("user", "c\n\nq"), ("assistant", "a")]),
    8: ({"role": "user", "text": "one"}, [("user", "one")]),
    9: ({"turns": [{"role": "user", "text": ""}]}, [("user", "")]),
    10: ({"prompt": "p", "completion": "c", "response": "other layout as well"}, [("user", "p"), ("assistant", "c")]),
    11: ({"prompt": "alone"}, None),
    12: ({"messages": []}, None),
}


def test_json_records_of_mixed_layouts(spark):
    rows = [(k, json.dumps(v[0])) for k, v in RECORDS.items()] + [(13, "not json"), (14, None), (15, "[]")]
    got: dict = {}
    for r in cf.turns_of_json(spark.createDataFrame(rows, "conv_id long, json string")).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text) if r.layout else None)
    want = {k: v[1] or [None] for k, v in RECORDS.items()} | {13: [None], 14: [None], 15: [None]}
    assert got == want


def test_nested_tables_pick_a_layout_by_schema(spark):
    df = spark.createDataFrame([(4, [("human", "q"), ("gpt", "a")], "x")], "conv_id long, conversations array<struct<from:string,value:string>>, source string")
    assert cf.layout_of_schema(df.schema).name == "messages of from and value"
    assert [tuple(r) for r in cf.turns_of_table(df).select("turn", "role", "text").orderBy("turn").collect()] == [(0, "user", "q"), (1, "assistant", "a")]
    flat = spark.createDataFrame([(5, "do", "done")], "conv_id long, instruction string, output string")
    assert [tuple(r) for r in cf.turns_of_table(flat).select("turn", "role", "text").orderBy("turn").collect()] == [(0, "user", "do"), (1, "assistant", "done")]


# ------------------------------------------------------------------ repair
def plain_repair(rows):
    """[(role, text)] in order -> (blank, duplicate, truncated, illegal, cost, audit, sha256), by trying every edit."""
    seen, state_rows, counts = set(), [], [0, 0, 0]
    for role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        state_rows.append((role, text, fault))
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}  # what may follow each last initial

    @lru_cache(None)
    def best(i, state, inserted):
        """Least (cost, audit, lines) from row i on."""
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text, fault = state_rows[i]
            c, a, o = best(i + 1, state, 0)
            found.append((c + 4, "D" + a, o))
            if fault not in (0, 1):
                more = 3 * (fault == 2)
                if role[:1] and role[:1] in allowed[state]:
                    c, a, o = best(i + 1, role[:1], 0)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *o)))
                for to in ("user", "assistant"):
                    if to[0] in allowed[state]:
                        c, a, o = best(i + 1, to[0], 0)
                        found.append((c + 3 + more, "R" + a, (f"{to}:{text}", *o)))
        if inserted < 3:
            for to in ("user", "assistant"):
                if to[0] in allowed[state]:
                    c, a, o = best(i, to[0], inserted + 1)
                    found.append((c + 3, "I" + a, (f"{to}:", *o)))
        return min(found, default=(10**9, "~", ()))

    for i in range(len(rows), -1, -1):  # shallow recursion
        for s in ("", "s", "u", "a"):
            best(i, s, 0)
    illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    c, a, o = best(0, "", 0)
    return (*counts, illegal, c, a, hashlib.sha256("\n".join(o).encode()).hexdigest())


def plain_all(rows):
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role, hashlib.sha256(text.encode()).digest(), text))
    out = []
    for c, mine in by.items():
        mine.sort(key=lambda r: r[:4])
        turns = [r[1] for r in mine if r[0]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *plain_repair([(r[2], r[4]) for r in mine])))
    return sorted(out, key=str)


def some_rows(seed, convs, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Yes. \t", "other", "end?"]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            text = rng.choice(texts) if rng.random() < 0.4 else f"{rng.random()}{rng.choice(['.', '', '?'])}"
            rows.append((c, rng.choice([t, t, t, t + 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u2"]), text))
    return rows + [(99, 1, "user", "same.")] * 30 + [(None, 0, "system", "null id.")] + [(98, None, "tool", "none of them")]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_trying_every_edit(spark, seed):
    rows = some_rows(seed, 25, 12)
    df = spark.createDataFrame(rows, CONV)
    got = [tuple(r) for r in cr.repaired(df.select("conv_id"), df, chunk_rows=5).collect()]
    assert sorted(got, key=str) == plain_all(rows)


def test_one_conversation_over_many_chunks(spark):
    rng = random.Random(7)
    rows = [(1, t, "user" if t % 3 else rng.choice(["assistant", "system"]), f"{t}{rng.choice(['.', '.', ''])}") for t in range(700)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(400)]  # needs no edit: every chunk's guess of the rest differs
    rows += [(3, 0, "user", "x.")] * 50 + [(3, 1, "tool", "y")] * 50
    df = spark.createDataFrame(rows, CONV)
    codes = cr.row_codes(df)
    pieces = cr.chunks(codes, chunk_rows=20)
    assert pieces.where("conv_id = 1").count() > 10 and pieces.agg(F.sum(F.length("codes"))).first()[0] == codes.count()
    got = [tuple(r) for r in cr.repaired(df.select("conv_id"), df, chunk_rows=20).collect()]
    assert sorted(got, key=str) == plain_all(rows)


def test_fix_up_stops_where_costs_differ_by_a_constant():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        codes = bytes(rng.randint(0, 8) for _ in range(rng.randint(1, 30)))
        copies = np.array([rng.choice([1, 1, 3]) for _ in codes])
        guess, right = (0, 0, 0, 0), tuple(x + 5 for x in cr.FINAL)
        start = cr.backward(codes, copies, guess)
        assert cr.backward(codes, copies, right, guess, start) == cr.backward(codes, copies, right)


def test_damage_follows_the_rule(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three? Four") for c in range(12) for t in range(4)] + [(None, None, None, None), (None, 3, "user", "x.")]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text)
            want += [row] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in cr.damaged(spark.createDataFrame(rows, CONV).withColumn("kind", F.lit("clash"))).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_conversations_without_rows_and_empty(spark):
    ids = spark.createDataFrame([(1,), (1,), (None,)], "conv_id long")
    none = spark.createDataFrame([], CONV)
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted([tuple(r) for r in cr.repaired(ids, none).collect()], key=str) == sorted([(1, 0, 0, 0, 0, 0, 0, "", empty), (None, 0, 0, 0, 0, 0, 0, "", empty)], key=str)
    assert cr.repaired(ids.limit(0), none).collect() == []


def test_very_long_texts(spark):
    long = "word " * 400_000
    df = spark.createDataFrame([(1, 0, "user", long + "end."), (1, 1, "assistant", long)], CONV)
    row = cr.repaired(df, df).first()
    assert (row.audit, row.cost, row.truncated) == ("KK", 3, 1) and row.repaired_sha256 == hashlib.sha256(f"user:{long}end.\nassistant:{long}".encode()).hexdigest()
    assert cf.read_back(cf.format_turns(cf.turns_of_table(df))).first().loss_chars == len(long)
