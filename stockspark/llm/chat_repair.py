"""Conversation structure repair: rank-convergence parallel Viterbi.

The rows of all conversations, in order, are cut into chunks by range partitioning, so a long
conversation spans many chunks. Rows travel as one byte each (what is wrong with the row, first
letter of its role); texts do not.

A chunk's backward costs (cheapest repair of the rest, for each state of the role grammar) need
the costs at its end. Every chunk starts at once from a speculative cost vector; fix-up passes
compare it with the vector that the next chunk found and rerun the chunk where the two differ by
more than a constant, until none does (a chunk's last vector is exact, so at most as many passes
as chunks, mostly one). A rerun stops at the row from which on its costs differ from the old ones
by a constant. Stitching adds the constants up from the last chunk to the first and passes the
state on from the first to the last; then every chunk traces its own part of the least audit.

Cost vectors less their least entry take few values, so the walk over rows is a table look-up.

Grammar of role initials: ``(s?(ua)+)?``. States: 0 nothing yet, 1 after s, 2 after u, 3 after a.

Defined cases: null ids, turns, roles and texts count as one space where they are text; null turns
come first; rows of one turn go by role, then by SHA-256 of the text; identical rows are one row
with a count; an empty role cannot be kept; a null conversation id is a conversation; very long
texts are hashed by Spark and streamed once; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockspark.llm.common import column, stored

#: Rows of one chunk.
CHUNK_ROWS = 1 << 19
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Costs after the last row: nothing yet or after a: done; after u: one insertion; after s: two.
FINAL = (0, 6, 3, 0)
_ANY = (0, 0, 0, 0)
#: The state that the next letter of the alternation leads to, and that letter's role.
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_INITIALS = "sua"
#: Codes: 0 must go; else 1 + 2 * (index of the initial in "sua", or 3) + truncated.
MUST_GO = 0
SPACE = " \t\n\v\f\r"


def _kept_state(state: int, initial: int) -> int | None:
    """State after a row that keeps its role, if the grammar allows it."""
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def _steps(code: int, after: tuple[int, ...], state: int) -> list[tuple[int, str, int]]:
    """(cost to the end, letter, state) of the edits that use the row up."""
    out = [(DELETE + after[state], "D", state)]
    if code != MUST_GO:
        initial, cut = divmod(code - 1, 2)
        more = TRUNCATED * cut
        to = _kept_state(state, initial)
        if to is not None:
            out.append((KEEP + more + after[to], "K", to))
        out.append((REROLE + more + after[_NEXT[state]], "R", _NEXT[state]))
    return out


@lru_cache(maxsize=1 << 16)
def _before(code: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs before the row less their least, and that least."""
    own = [min(c for c, _, _ in _steps(code, after, s)) for s in range(4)]
    for _ in range(2):  # more insertions in a row only come back to a state
        own = [min(own[s], INSERT + own[_NEXT[s]]) for s in range(4)]
    low = min(own)
    return tuple(c - low for c in own), low


@lru_cache(maxsize=1 << 16)
def _edit(code: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least cheapest letters up to the one that uses the row up, and the state then."""
    before, low = _before(code, after)
    letters = ""
    while True:
        left = before[state] + low
        for cost, letter, to in sorted((x for x in [*_steps(code, after, state), (INSERT + before[_NEXT[state]] + low, "I", _NEXT[state])]), key=lambda x: x[1]):
            if cost == left:
                letters, state = letters + letter, to
                break
        if letters[-1] != "I":
            return letters, state


def _less(v: Iterable[int]) -> tuple[tuple[int, ...], int]:
    v = tuple(int(x) for x in v)
    return tuple(x - min(v) for x in v), min(v)


def backward(codes: bytes, copies: np.ndarray, end: Iterable[int], old_end: Iterable[int] | None = None, old_start: Iterable[int] | None = None) -> tuple[int, ...]:
    """Costs at the chunk's start from those at its end.

    With the vectors of an earlier run, the walk stops where both runs differ by a constant only.
    """
    v, total = _less(end)
    old, old_total = _less(old_end) if old_end is not None else (None, 0)
    for at in range(len(codes) - 1, -1, -1):
        if old is not None:
            if old == v:
                return tuple(int(x) + total - old_total for x in old_start)
            old, low = _before(codes[at], old)
            old_total += low + DELETE * int(copies[at] - 1)
        v, low = _before(codes[at], v)
        total += low + DELETE * int(copies[at] - 1)
    return tuple(x + total for x in v)


def after_rows(codes: bytes, end: Iterable[int]) -> list[tuple[int, ...]]:
    """Per row, the costs behind it less their least."""
    v, _ = _less(end)
    out = [v] * len(codes)
    for at in range(len(codes) - 1, 0, -1):
        v, _ = _before(codes[at], v)
        out[at - 1] = v
    return out


def trace(codes: bytes, copies: np.ndarray, end: Iterable[int], state: int) -> tuple[list[str], int]:
    """Per row of the chunk the letters of its edits (its copies are deleted), and the last state."""
    letters = []
    for code, after, n in zip(codes, after_rows(codes, end), copies.tolist()):
        own, state = _edit(code, after, state)
        letters.append(own + "D" * (n - 1))
    return letters, state


# ------------------------------------------------------------------ rows
def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage of the query; rows that it repeats appear twice."""
    conv, turn = column(conversations, "conv_id"), column(conversations, "turn")
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of(conv), F.lit(":"), text_of(turn)).cast("binary")) % 20
    role, text = text_of(column(conversations, "role")), text_of(column(conversations, "text"))
    rows = conversations.select(
        conv.cast("bigint").alias("conv_id"),
        turn.cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        kind.alias("kind"),
    ).where("kind <> 0")
    return rows.withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "again")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def row_codes(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, code, blank, truncated): identical rows as one, with a code for the first of them.

    Copies are counted before the shuffle; the first occurrence is looked up by the whole key, so
    a text that fills a conversation is no hot key.
    """
    said = F.rtrim("text", F.lit(SPACE))
    blank = said == ""
    cut = ~blank & ~F.substring(said, -1, 1).isin(".", "!", "?")
    keyed = rows.select("conv_id", "turn", "role", _digest(), blank.alias("blank"), cut.alias("truncated"))
    same = keyed.groupBy("conv_id", "turn", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated"))
    order = F.struct(F.col("turn").isNotNull().alias("k"), "turn")
    firsts = same.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("f")).select(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("f.turn").alias("t"), F.lit(True).alias("first")
    )
    found = same.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    initial = F.substring("role", 1, 1)
    index = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    first = F.coalesce("first", F.lit(False))
    code = F.when(F.col("blank") | ~first, F.lit(MUST_GO)).otherwise(1 + 2 * index + F.col("truncated").cast("int"))
    duplicates = F.when(F.col("blank"), F.lit(0)).when(first, F.col("n") - 1).otherwise(F.col("n"))
    return found.select(
        "conv_id", "turn", "role", "digest", "n", code.cast("tinyint").alias("code"), initial.alias("initial"),
        F.when(F.col("blank"), F.col("n")).otherwise(0).cast("bigint").alias("blank"), duplicates.cast("bigint").alias("duplicate"),
        (first & F.col("truncated")).cast("bigint").alias("truncated"),
    )


CHUNKS = (
    "conv_id bigint, part int, codes binary, copies binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "first_initial string, last_initial string, turns bigint, first_turn bigint, last_turn bigint"
)
_CHUNKS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("codes", pa.binary()), ("copies", pa.binary()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()), ("turns", pa.int64()),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()),
])
_LEGAL = {"su", "ua", "au"}


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted partition -> one row per conversation in it."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    now, open_ = None, None
    done: list[tuple] = []

    def close() -> None:
        codes, copies, blank, dup, cut, bad, first, last, turns = open_
        seen = [t for t in turns if t is not None]
        done.append((now, part, bytes(codes), np.array(copies, dtype=np.int64).tobytes(), blank, dup, cut, bad, first, last, len(seen), seen[0] if seen else None, seen[-1] if seen else None))

    for batch in batches:
        for conv, turn, n, code, initial, blank, dup, cut in zip(*(c.to_pylist() for c in batch.columns)):
            if open_ is None or conv != now:
                if open_ is not None:
                    close()
                now, open_ = conv, [bytearray(), [], 0, 0, 0, 0, initial, None, []]
            elif open_[7] + initial not in _LEGAL:
                open_[5] += 1
            open_[0].append(code)
            open_[1].append(n)
            for at, x in ((2, blank), (3, dup), (4, cut), (5, n - 1 if initial + initial not in _LEGAL else 0)):
                open_[at] += x
            open_[7] = initial
            if not open_[8] or open_[8][-1] != turn:
                open_[8].append(turn)
        yield _emit(done, _CHUNKS)
        done = []
    if open_ is not None:
        close()
        yield _emit(done, _CHUNKS)


def chunks(codes: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The conversations cut at the borders of a range partitioning; kept in the shared folder, as the borders come from a sample."""
    codes = stored(codes, "repair-codes")
    n = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-codes.count() // chunk_rows))
    ordered = codes.repartitionByRange(n, "conv_id", F.col("turn").asc_nulls_first(), "role", "digest").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    cut = ordered.select("conv_id", "turn", "n", "code", "initial", "blank", "duplicate", "truncated").mapInArrow(_cut, CHUNKS)
    # a conversation has at most one row per partition, so this window is bounded
    following = F.lead("part").over(Window.partitionBy("conv_id").orderBy("part"))
    return stored(stored(cut, "repair-cut").withColumn("next", following), "repair-chunks")


# ------------------------------------------------------------------ passes
VECTORS = "conv_id bigint, part int, next int, used array<bigint>, start array<bigint>"
_VECTORS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("next", pa.int32()), ("used", pa.list_(pa.int64())), ("start", pa.list_(pa.int64()))])


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backward costs of chunks: (conv_id, part, next, codes, copies, end, old end, old start)."""
    for batch in batches:
        out = []
        for conv, part, following, codes, copies, end, old_end, old_start in zip(*(c.to_pylist() for c in batch.columns)):
            end = end or (FINAL if following is None else _ANY)
            out.append((conv, part, following, end, backward(codes, np.frombuffer(copies, dtype=np.int64), end, old_end, old_start)))
        yield _emit(out, _VECTORS)


def _by_constant(a: Column, b: Column) -> Column:
    """Whether two vectors differ by a constant only."""
    return F.size(F.array_distinct(F.zip_with(a, b, lambda x, y: x - y))) == 1


def cost_vectors(pieces: DataFrame) -> DataFrame:
    """Backward cost vectors of every chunk, each from an end vector that is right up to a constant."""
    none = F.lit(None).cast("array<bigint>")
    own = ["conv_id", "part", "next", "codes", "copies"]
    found = stored(pieces.select(*own, none.alias("end"), none.alias("old_end"), none.alias("old_start")).mapInArrow(_run, VECTORS), "repair-vectors")
    while True:
        ends = found.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("start").alias("right"))
        wrong = found.where("next is not null").join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("next") == F.col("p"))).where(~_by_constant(F.col("used"), F.col("right")))
        wrong = stored(wrong.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("right").alias("end"), F.col("used").alias("old_end"), F.col("start").alias("old_start")), "repair-wrong")
        if wrong.isEmpty():
            return found
        here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
        again = pieces.join(wrong, here).select(*own, "end", "old_end", "old_start").mapInArrow(_run, VECTORS)
        found = stored(found.join(wrong.select("c", "p"), here, "left_anti").unionByName(again), "repair-vectors")


TRACED = "conv_id bigint, part int, state int"
_TRACED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("state", pa.int32())])
_MAPS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("states", pa.list_(pa.int32()))])


def _maps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last state of a chunk for each state that it may begin in."""
    for batch in batches:
        out = []
        for conv, part, codes, used in zip(*(c.to_pylist() for c in batch.columns)):
            after = after_rows(codes, used)
            states = [0, 1, 2, 3]
            for code, v in zip(codes, after):
                states = [_edit(code, v, s)[1] for s in states]
            out.append((conv, part, states))
        yield _emit(out, _MAPS)


def _states(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation in order -> the state that each begins in."""
    now, state, begun = None, 0, False
    for batch in batches:
        out = []
        for conv, part, states in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or conv != now:
                now, state, begun = conv, 0, True
            out.append((conv, part, state))
            state = states[state]
        yield _emit(out, _TRACED)


def begin_states(pieces: DataFrame, vectors: DataFrame) -> DataFrame:
    """(conv_id, part, state) of the chunks of conversations with more than one chunk."""
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    long = pieces.where("next is not null").select(F.col("conv_id").alias("c")).distinct()
    parts = pieces.join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    ends = vectors.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "used")
    maps = parts.join(ends, here).select("conv_id", "part", "codes", "used").mapInArrow(_maps, "conv_id bigint, part int, states array<int>")
    return maps.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_states, TRACED)


PLAN = "conv_id bigint, part int, state int, letters array<string>, cost bigint"
_PLAN = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("state", pa.int32()), ("letters", pa.list_(pa.string())), ("cost", pa.int64())])


def _trace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, part, following, codes, copies, used, start, state in zip(*(c.to_pylist() for c in batch.columns)):
            letters, last = trace(codes, np.frombuffer(copies, dtype=np.int64), used, state)
            if following is None:  # what the conversation still lacks
                letters.append("I" * (FINAL[last] // INSERT))
            # the chunk's own share: costs at its start less those at its end, which hold the same constant
            out.append((conv, part, state, letters, start[state] - (used[last] if following is not None else 0)))
        yield _emit(out, _PLAN)


def plans(pieces: DataFrame, vectors: DataFrame, states: DataFrame) -> DataFrame:
    """Per chunk the letters of each row's edits and the chunk's cost; the costs of a conversation's chunks add up to its own."""
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    with_vectors = pieces.join(vectors.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "used", "start"), here).drop("c", "p")
    known = states.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("state"))
    placed = with_vectors.join(known, here, "left")
    return placed.select("conv_id", "part", "next", "codes", "copies", "used", "start", F.coalesce("state", F.lit(0)).alias("state")).mapInArrow(_trace, PLAN)


# ------------------------------------------------------------------ repaired text
REPAIRED = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_REPAIRED = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial")


class _Conversation:
    """What a task holds of one conversation: sums, the letters of its edits, a running digest."""

    def __init__(self, conv: int | None):
        self.conv, self.sums, self.cost, self.letters, self.audit = conv, [0] * 4, 0, [], []
        self.turns, self.first, self.last, self.initial = 0, None, None, None
        self.at, self.state, self.hash, self.lines, self.key = 0, 0, hashlib.sha256(), 0, None

    def chunk(self, letters: list[str], cost: int, blank, duplicate, truncated, illegal, turns, first_turn, last_turn, first_initial, last_initial) -> None:
        for i, x in enumerate((blank, duplicate, truncated, illegal)):
            self.sums[i] += x
        if self.initial is not None and self.initial + first_initial not in _LEGAL:
            self.sums[3] += 1
        self.initial = last_initial
        self.turns += turns - (turns > 0 and self.last == first_turn)
        self.first = first_turn if self.first is None else self.first
        self.last = last_turn if last_turn is not None else self.last
        self.cost += cost
        self.letters += letters

    def line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode())
        self.lines += 1

    def edits(self, role: str, text: str) -> None:
        """Applies the letters of the next row."""
        own = self.letters[self.at]
        self.at += 1
        for letter in own.rstrip("D"):
            self.apply(letter, role, text)

    def apply(self, letter: str, role: str, text: str) -> None:
        if letter == "K":
            self.state = _kept_state(self.state, _INITIALS.index(role[0]))
            self.line(role, text)
        elif letter in "RI":
            self.state = _NEXT[self.state]
            self.line(_ROLE[self.state], text if letter == "R" else "")

    def row(self) -> tuple:
        for own in self.letters[self.at :]:
            for letter in own:
                self.apply(letter, "", "")
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.sums, self.cost, "".join(self.letters), self.hash.hexdigest()


def _apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (part given) come before the texts of their conversation; equal texts of a turn are one row."""
    now: _Conversation | None = None
    for batch in batches:
        done = []
        for conv, part, turn, role, digest, text, letters, cost, *counts in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    done.append(now.row())
                now = _Conversation(conv)
            if part is not None:
                now.chunk(letters, cost, *counts)
            elif digest is not None and (turn, role, digest) != now.key:
                now.key = (turn, role, digest)
                now.edits(role, text)
        yield _emit(done, _REPAIRED)
    if now is not None:
        yield _emit([now.row()], _REPAIRED)


def repaired(ids: DataFrame, rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per conversation of ``ids``: its faults, the cheapest repair of its ``rows`` and the digest of the repaired text.

    The texts are shuffled once, sorted by Spark and streamed against the letters of their edits.
    """
    pieces = chunks(row_codes(rows), chunk_rows)
    vectors = cost_vectors(pieces)
    states = stored(begin_states(pieces, vectors), "repair-states")
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))
    found = plans(pieces, vectors, states).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "letters", "cost")
    solved = pieces.join(found, here).select("conv_id", "part", "letters", "cost", *_COUNTS)
    columns = ["conv_id", "part", "turn", "role", "digest", "text", "letters", "cost", *_COUNTS]
    texts = rows.select("conv_id", "turn", "role", _digest(), "text")
    known = ids.select(column(ids, "conv_id").cast("bigint").alias("conv_id")).distinct()
    every = known.unionByName(solved, allowMissingColumns=True).unionByName(texts, allowMissingColumns=True)
    ordered = every.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "digest")
    return ordered.mapInArrow(_apply, REPAIRED)
