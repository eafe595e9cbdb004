"""Chat formatting by schema fingerprints.

A layout declares where the turns of a record are: rules of (role, texts), each a field path
or a fixed ``=role``. The nested field paths that a record has, as far as a layout names them,
are hashed; a layout whose hash is found maps the record to turns. Tables have one fingerprint,
taken from their schema when the plan is built; JSON records have one each, taken by Spark's
own functions, so no record passes through Python.

Formatting is a map over turns: ``### role: text</turn>`` and a line end. Control strings
inside roles and texts are escaped with backslashes, so that every formatted turn can be read
back exactly. The loss mask is one span of characters of each assistant turn.

Reading back streams the formatted turns of a conversation in order; of a conversation it holds
one turn and two running digests, so a conversation of any length passes through.

Defined cases: a null text or role is an empty one; an empty text is a turn like any other; a
null conversation id is a conversation of its own; turns of the same number, repeated rows
included, all count, in the order of what they are formatted to; null turn numbers come first;
other columns are ignored, also those that another layout uses (the first layout that fits
counts); a JSON record that fits no layout or cannot be parsed comes back as one row without a
layout and turn; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockspark.llm.common import column

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
#: The role whose texts are under the loss mask.
LEARNED = "assistant"


@dataclass(frozen=True)
class Rule:
    """One turn, or one per element of a list: its role (a path, or ``=fixed``) and the paths whose texts make it up."""

    role: str
    texts: tuple[str, ...]


@dataclass(frozen=True)
class Layout:
    name: str
    rules: tuple[Rule, ...]
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        named = [p for r in self.rules for p in (r.role, *r.texts) if not p.startswith("=")]
        return sorted(dict.fromkeys(named))

    def fingerprints(self) -> set[str]:
        """Of every set of paths that this layout takes: those it needs, with any of the optional ones."""
        needed = [p for p in self.paths() if p not in self.optional]
        return {fingerprint([*needed, *some]) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)}


_SPOKEN = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Layouts in the order in which they are tried.
LAYOUTS = (
    Layout("turn rows", (Rule("role", ("text",)),)),
    Layout("messages", (Rule("messages[].role", ("messages[].content",)),), roles=_SPOKEN),
    Layout("messages of from and value", (Rule("conversations[].from", ("conversations[].value",)),), roles=_SPOKEN),
    Layout("messages of role and text", (Rule("turns[].role", ("turns[].text",)),), roles=_SPOKEN),
    Layout(
        "instruction",
        (Rule("=system", ("system",)), Rule("=user", ("instruction", "input")), Rule("=assistant", ("output",))),
        optional=("system", "input"),
    ),
    Layout("prompt and completion", (Rule("=system", ("system",)), Rule("=user", ("prompt",)), Rule("=assistant", ("completion",))), optional=("system",)),
    Layout("prompt and response", (Rule("=system", ("system",)), Rule("=user", ("prompt",)), Rule("=assistant", ("response",))), optional=("system",)),
    Layout("question and answer", (Rule("=user", ("context", "question")), Rule("=assistant", ("answer",))), optional=("context",)),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


# ------------------------------------------------------------------ layouts -> turns
def schema_paths(schema: T.StructType, prefix: str = "") -> set[str]:
    """Paths of all nested fields; ``[]`` stands for the elements of a list."""
    out = set()
    for f in schema.fields:
        path, kind = prefix + f.name, f.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        out |= schema_paths(kind, path + ".") if isinstance(kind, T.StructType) else {path}
    return out


def layout_of_schema(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    have = schema_paths(schema)
    return next((x for x in layouts if fingerprint(have.intersection(x.paths())) in x.fingerprints()), None)


def _json_schema(layouts: tuple[Layout, ...]) -> T.StructType:
    """Every path of the layouts as a text field."""
    tree: dict = {}
    for path in sorted({p for x in layouts for p in x.paths()}):
        at = tree
        for step in path.split("."):
            at = at.setdefault(step, {})

    def kind(node: dict) -> T.StructType:
        fields = []
        for name, below in node.items():
            inner = kind(below) if below else T.StringType()
            fields.append(T.StructField(name.removesuffix("[]"), T.ArrayType(inner) if name.endswith("[]") else inner))
        return T.StructType(fields)

    return kind(tree)


def _has(path: str, record: Column) -> Column:
    if "[]" not in path:
        return record[path].isNotNull()
    items, inner = path.split("[].")
    return F.coalesce(F.exists(record[items], lambda e: e[inner].isNotNull()), F.lit(False))


def _text(parts: list[Column]) -> Column:
    """The parts that are there, an empty line between them."""
    return parts[0] if len(parts) == 1 else F.array_join(F.array_compact(F.array(*parts)), "\n\n")


def _turns(layout: Layout, record: Column, have: set[str] | None = None) -> Column:
    """The layout's turns as an array of (role, text)."""

    def role(c: Column) -> Column:
        for said, meant in layout.roles.items():
            c = F.when(F.lower(c) == said, F.lit(meant)).otherwise(c)
        return c

    def one(rule: Rule) -> Column:
        paths = [p for p in (rule.role, *rule.texts) if not p.startswith("=")]
        items = next((p.split("[].")[0] for p in paths if "[]" in p), None)
        if items:
            of = lambda e, p: F.lit(p[1:]) if p.startswith("=") else e[p.split("[].")[1]]
            return F.transform(record[items], lambda e: F.struct(role(of(e, rule.role)).alias("role"), _text([of(e, p) for p in rule.texts]).alias("text")))
        there = [p for p in rule.texts if have is None or p in have]
        if not there:
            return F.array().cast("array<struct<role:string,text:string>>")
        fixed = F.lit(rule.role[1:]) if rule.role.startswith("=") else role(record[rule.role])
        turn = F.array(F.struct(fixed.alias("role"), _text([record[p].cast("string") for p in there]).alias("text")))
        absent = F.lit(True)
        for p in there:
            absent = absent & record[p].isNull() if p in layout.optional else F.lit(False)
        return F.when(absent, F.slice(turn, 1, 0)).otherwise(turn)

    return F.concat(*[one(r).cast("array<struct<role:string,text:string>>") for r in layout.rules])


def turns_of_table(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, turn, role, text, layout) of a typed table; its schema's fingerprint picks the layout.

    A table of turn rows has its own turn numbers, others number the turns of each row from 0.
    """
    layout = layout_of_schema(table.schema)
    if layout is None:
        raise ValueError(f"no layout fits the fields {sorted(schema_paths(table.schema))}")
    have = schema_paths(table.schema)
    record = F.struct(*[column(table, c) for c in table.columns])
    base = table.select(column(table, conv_id).cast("bigint").alias("conv_id"), *([column(table, turn).cast("bigint").alias("turn")] if layout.name == "turn rows" else []), record.alias("r"))
    if layout.name == "turn rows":
        return base.select("conv_id", "turn", F.col("r.role").alias("role"), F.col("r.text").alias("text"), F.lit(layout.name).alias("layout"))
    return base.select("conv_id", F.posexplode(_turns(layout, F.col("r"), have)).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("bigint"), "t.role", "t.text", F.lit(layout.name).alias("layout")
    )


def turns_of_json(records: DataFrame, conv_id: str = "conv_id", json: str = "json", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text, layout) of JSON records of mixed layouts; one row with a null layout for a record that fits none."""
    r = F.col("r")
    pick, made = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for x in reversed(layouts):
        paths = F.array_compact(F.array(*[F.when(_has(p, r), F.lit(p)) for p in x.paths()]))
        fits = F.md5(F.array_join(paths, "\n").cast("binary")).isin(*sorted(x.fingerprints()))
        pick = F.when(fits, F.lit(x.name)).otherwise(pick)
        made = F.when(fits, _turns(x, r)).otherwise(made)
    parsed = records.select(column(records, conv_id).cast("bigint").alias("conv_id"), F.from_json(column(records, json), _json_schema(layouts)).alias("r"))
    return parsed.select("conv_id", pick.alias("layout"), F.posexplode_outer(made).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("bigint"), "t.role", "t.text", "layout"
    )


# ------------------------------------------------------------------ format
def _escaped(c: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("#", "\\#"), ("</", "<\\/")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end): each turn by the template; the span is of code points of ``formatted``, null where nothing is learned."""
    role, text = F.coalesce(column(turns, "role"), F.lit("")), F.coalesce(column(turns, "text"), F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(_escaped(role), F.lit(":"), F.lit("\\:")), F.lit(MIDDLE))
    start = F.when(role == LEARNED, F.length(head))
    cells = turns.select(column(turns, "conv_id").alias("conv_id"), column(turns, "turn").alias("turn"), head.alias("head"), _escaped(text).alias("body"), start.alias("loss_start"))
    return cells.select("conv_id", "turn", F.concat("head", "body", F.lit(CLOSE)).alias("formatted"), "loss_start", (F.col("loss_start") + F.length("body")).alias("loss_end"))


# ------------------------------------------------------------------ read back
_HEAD = re.compile(re.escape(OPEN) + r"((?:[^\\:]|\\.)*)" + re.escape(MIDDLE), re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


class Reader:
    """Takes the formatted text of one conversation piece by piece and keeps its digests."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, loss: Iterable[tuple[int, int]]) -> None:
        self.chars += len(piece)
        for start, end in loss:
            learned = unescape(piece[start:end])
            self.loss_chars += len(learned)
            self.loss_hash.update(learned.encode())
        self.rest += piece
        at = 0
        while (end := self.rest.find(CLOSE, at)) >= 0:
            head = _HEAD.match(self.rest, at, end)
            if head is None:
                raise ValueError("not a formatted turn: " + self.rest[at : at + 80])
            self.turns += 1
            self.turns_hash.update(f"{unescape(head[1])}\n{unescape(self.rest[head.end():end])}\n".encode())
            at = end + len(CLOSE)
        self.rest = self.rest[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("unfinished turn: " + self.rest[:80])
        return self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, reader, done = None, None, []
    for batch in batches:
        for conv, piece, start, end in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if reader is None or conv != now:
                if reader is not None:
                    done.append((now, *reader.row()))
                now, reader = conv, Reader()
            reader.feed(piece, [] if start is None else [(start, end)])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], type=f.type) for i, f in enumerate(_DIGEST)], schema=_DIGEST)
        done = []
    if reader is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((now, *reader.row()), _DIGEST)], schema=_DIGEST)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and its loss spans alone: turns, digests, characters.

    One shuffle by conversation, sorted by Spark (which spills); a task then streams them.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted", "loss_start")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(_read, DIGEST)
