"""Single-document backups, read and written over many tasks (A3, A4).

The document is ``{"timestamp": .., "version": .., "data": {"<table>": [{..}, ..], ..}}``, in any
white space, on one line or many.  It is one file, or a folder of part files that give the
document when they are put together in name order.

Reading: Spark splits the file into byte ranges and cuts them before every ``{`` (its text reader
with that separator), so no task needs the text before its range.  What it does need is whether
the range begins inside a string and how deep it is nested.  A first pass finds, per range, how
both change over it, for either start (a quote toggles the one into the other); a few numbers per
range are then composed in order.  In the second pass every range finds the records that begin in
it; a record over a range's border comes in fragments that are put together by the range in which
it began.

Writing: Spark sorts the rows of every table, puts them into JSON and writes them as ordered
parts.  The parts may be compressed; put together as they are, they then give the compressed
document.

Limits: a table name must not hold ``{``; records of one table must be objects.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, shuffles_dropped
from . import backup
from .backup import BACKUP_VERSION, _record, restored
from .fixtures import literal_rows

#: Nesting at which the records of a table lie: document, data, table.
RECORD_DEPTH = 3

_RANGE = ["file", "start"]
#: What a byte is: 2 for a quote, 1 for a bracket that opens, -1 for one that closes.
_MARK = bytes({ord('"'): 2, ord("{"): 1, ord("["): 1, ord("}"): 255, ord("]"): 255}.get(b, 0) for b in range(256))


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(range, text, places of its quotes and brackets, their marks, further columns) of what a batch holds of a range.

    A range is named by the first two columns, the second is its start in the file.  Escaped characters are blanked out before marks are looked for.
    """
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, value, *more = batch.columns
        border = np.diff(file.dictionary_encode().indices.to_numpy()) != 0
        border |= np.diff(start.to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(border) + 1).tolist(), batch.num_rows]
        pieces = value.cast(pa.binary()).to_pylist()
        for s, e in zip(cuts, cuts[1:]):
            here = (file[s].as_py(), start[s].as_py())
            text = b"{".join(pieces[s:e])
            if here == now or here[1] != 0:  # only a file's first piece has no bracket before it
                text = b"{" + text
            now = here
            masked = text.replace(b"\\\\", b"  ").replace(b'\\"', b"  ") if b"\\" in text else text
            mark = np.frombuffer(masked.translate(_MARK), dtype=np.int8)
            at = np.flatnonzero(mark != 0)
            yield here, text, at, mark[at].astype(np.int64), *(c[s].as_py() for c in more)


_SHAPE = "file string, start bigint, quotes boolean, outside bigint, inside bigint"


def _shapes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether its quotes toggle the state, and its change of depth when it starts outside or inside a string."""
    ranges: dict = {}
    for here, _, _, mark in _stretches(batches):
        shape = ranges.setdefault(here, [0, 0, 0])  # parity, change by the even and by the odd stretches between quotes
        quote = mark == 2
        odd = (np.cumsum(quote) + shape[0]) & 1
        change = np.where(quote, 0, mark)
        shape[1] += int(change[odd == 0].sum())
        shape[2] += int(change[odd == 1].sum())
        shape[0] ^= int(quote.sum()) & 1
    rows = [(f, s, bool(q), a, b) for (f, s), (q, a, b) in ranges.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in _SHAPE.split(", ")])


#: at: number of the range in the document; opened: how many roots and tables begin in the range up to here;
#: kind: record (whole), head (begins a record), more (goes on with one), root and table (a key and what opens at it).
_FOUND = "at int, opened int, kind string, text string"


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, inside, depth, count = None, 0, 0, 0
    record, kind, key = None, "record", None  # what a record over the stretch's border has so far; the last string
    for here, text, at, mark, *begin in _stretches(batches):
        if here != now:
            if record is not None:
                yield _found([(now[0], count, "more" if kind == "more" else "head", b"".join(record))])
            now, (inside, depth), count, key = here, begin, 0, None
            record, kind = ([], "more") if depth > RECORD_DEPTH else (None, "record")
        out: list[tuple] = []
        quote = mark == 2
        live = ~quote & (((np.cumsum(quote) + inside) & 1) == 0)
        quotes, place, step = at[quote], at[live], mark[live]
        after = depth + np.cumsum(step)
        before = after - step

        def name(b: int) -> bytes | None:
            """The last string before ``b``, which lies outside of strings."""
            k = int(np.searchsorted(quotes, b))
            if not k:
                return key
            return text[int(quotes[k - 2]) + 1 if k > 1 else 0 : int(quotes[k - 1])]

        opens = []
        for b in place[(before < RECORD_DEPTH) & (before >= RECORD_DEPTH - 2) & (step > 0)].tolist():
            level = int(before[np.searchsorted(place, b)])
            if text[b : b + 1] == (b"{" if level == RECORD_DEPTH - 2 else b"["):
                opens.append(b)
                out.append((now[0], count + len(opens), "root" if level == RECORD_DEPTH - 2 else "table", name(b)))
        begins, ends = np.flatnonzero((before == RECORD_DEPTH) & (step > 0)), np.flatnonzero((after == RECORD_DEPTH) & (step < 0))
        if depth > RECORD_DEPTH:  # the stretch begins inside of a record
            if len(ends):
                if record is not None:
                    record.append(text[: int(place[ends[0]]) + 1])
                    out.append((now[0], count, kind, b"".join(record)))
                record, ends = None, ends[1:]
            elif record is not None:
                record.append(text)
        from_, to = place[begins].tolist(), (place[ends] + 1).tolist()
        for b, e, n in zip(from_, to, (count + np.searchsorted(opens, place[begins])).tolist()):
            if text[b : b + 1] == b"{":
                out.append((now[0], n, "record", text[b:e]))
        if len(from_) > len(to) and text[from_[-1] : from_[-1] + 1] == b"{":
            record, kind = [text[from_[-1] :]], "record"
        if len(quotes):
            key = name(len(text)) if not (inside + len(quotes)) & 1 else text[int(quotes[-1]) + 1 :]
        inside = (inside + len(quotes)) & 1
        count += len(opens)
        if len(step):
            depth = int(after[-1])
        yield _found(out)
    if record is not None:
        yield _found([(now[0], count, "more" if kind == "more" else "head", b"".join(record))])


def _found(rows: list[tuple]) -> pa.RecordBatch:
    at, opened, kind, text = zip(*rows) if rows else ((),) * 4
    columns = [pa.array(at, pa.int32()), pa.array(opened, pa.int32()), pa.array(kind, pa.string()), pa.array(text, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FOUND.split(", ")])


def _scan(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Column]]:
    """(every record with its place, which places belong to a table, by the tables' names) of the document at ``path``."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/stockspark/document-{uuid.uuid4().hex}"
    text = spark.read.option("lineSep", "{").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    # a few numbers per range, put in order here: a sort by Spark would look at the whole text twice
    shapes = sorted(text.mapInArrow(_shapes, _SHAPE).collect(), key=lambda r: (r.file, r.start))
    begins, inside, depth = [], False, 0
    for at, r in enumerate(shapes):
        begins.append((r.file, r.start, at, inside, depth))
        depth += r.inside if inside else r.outside
        inside ^= r.quotes
    # a broadcast join keeps the order of the text's rows
    known = F.broadcast(spark.createDataFrame(begins, "file string, start bigint, at int, in_string boolean, depth bigint"))
    found = text.join(known, _RANGE).select("at", "start", "value", "in_string", "depth").mapInArrow(_find, _FOUND)
    found.write.option("compression", "zstd").parquet(f"{root}/found")
    found = spark.read.schema(_FOUND).parquet(f"{root}/found")

    tables, inner = [], None
    for m in found.where("kind in ('root', 'table')").orderBy("at", "opened").collect():
        name = json.loads(f'"{m.text}"') if m.text is not None else None
        if m.kind == "root":
            inner = name
        tables.append((m.at, m.opened, name if m.kind == "table" and inner == "data" else None))
    at, opened = F.col("at"), F.col("opened")
    places: dict[str, list[Column]] = {}
    for (a, n, name), following in zip(tables, [*tables[1:], None]):
        if name is not None:  # plain comparisons: files skip what lies in other tables
            here = (at > a) | ((at == a) & (opened >= n))
            if following:
                here = here & ((at < following[0]) | ((at == following[0]) & (opened < following[1])))
            places.setdefault(name, []).append(here)

    records = found.where("kind = 'record'").drop("kind")
    begun = {r.at for r in found.where("kind = 'head'").select("at").collect()}
    if begun:  # records over a border
        owners, last = [], None
        for _, _, range_, _, deep in begins:
            if deep > RECORD_DEPTH and last is not None:
                owners.append((range_, last))
            if range_ in begun:
                last = range_
        owner = F.broadcast(spark.createDataFrame(owners, "at int, of int"))
        pieces = found.where("kind = 'head'").withColumn("of", F.col("at"))
        pieces = pieces.unionByName(found.where("kind = 'more'").join(owner, "at"))
        joined = pieces.groupBy("of").agg(
            F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"), F.max(F.when(F.col("kind") == "head", opened)).alias("opened")
        )  # one record each
        records = records.unionByName(joined.select(F.col("of").alias("at"), "opened", F.array_join("parts.text", "").alias("text")))
    return records, {name: reduce(or_, some) for name, some in places.items()}


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """((table, record JSON) of every record, the names of all tables) of the document at ``path``.

    The driver holds a few numbers per byte range (of ``spark.sql.files.maxPartitionBytes``) and
    one row per table.
    """
    records, places = _scan(spark, path)
    table = F.lit(None).cast("string")
    for name, here in places.items():
        table = F.when(here, F.lit(name)).otherwise(table)
    return records.select(table.alias("table"), F.col("text").alias("record")).where("table is not null"), list(places)


def read_backup_document(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Restore the tables of a document, as ``backup.read_backup`` does those of a directory."""
    records, places = _scan(spark, path)
    frames, status = {}, []
    for name, here in places.items():
        frame, line = restored(records.where(here).select(F.col("text").alias("value")), name)
        if frame is not None:
            frames[name] = frame
        status.append(line)
    return frames, backup._union_all(status)


def write_document(tables: dict[str, DataFrame], path: str, timestamp: str | None = None, compression: str = "none") -> None:
    """Write the tables, sorted by id, as one document in ordered parts under the folder ``path``.

    ``compression`` is that of the parts ("gzip"); reading goes by their names.
    Rows are shuffled as they are and put into JSON once, where they are written.
    """
    spark = next(iter(tables.values())).sparkSession
    between = json.dumps({"timestamp": timestamp or dt.datetime.now(dt.timezone.utc).isoformat(), "version": BACKUP_VERSION})[:-1] + ', "data": {'
    parts, seen = [], {}
    for i, (name, df) in enumerate(tables.items()):
        seen[name] = Observation(f"document-{uuid.uuid4().hex}")
        # rows with one id are in the order of a hash: it is the same each time a row is made, and no column more to shuffle
        by = [F.col("id").cast("bigint"), F.xxhash64(*df.columns)]
        rows = df.repartitionByRange(*by).sortWithinPartitions(*by).select(_record(df).alias("value"), F.monotonically_increasing_id().alias("n"))
        first = F.col("n") == 0  # the first of the first partition
        rows = rows.observe(seen[name], F.count(F.lit(1)).alias("rows"), F.count_if(first).alias("first"))
        parts += [_line(spark, f"{between}{json.dumps(name)}: ["), rows.select(F.concat(F.when(first, "").otherwise(","), "value").alias("value"))]
        between = "], "
    lines = parts[0]
    for part in [*parts[1:], _line(spark, "]}}")]:  # a union keeps the order of its parts
        lines = lines.union(part)
    files = lines.write.mode("overwrite").option("compression", compression)
    if compression != "none":
        files = files.option("maxRecordsPerFile", backup.COMPRESSED_RECORDS)
    with shuffles_dropped(spark):
        files.text(path)
    moved = [name for name, s in seen.items() if s.get["rows"] and not s.get["first"]]
    if moved:  # other rows each time they are made: the first partition was chosen for rows that did not come again
        root = f"{checkpoint_dir(spark).rstrip('/')}/stockspark/document-{uuid.uuid4().hex}"
        kept = dict(tables)
        for name in moved:
            tables[name].write.option("compression", "zstd").parquet(f"{root}/{name}")
            kept[name] = spark.read.schema(tables[name].schema).parquet(f"{root}/{name}")
        write_document(kept, path, timestamp, compression)


def _line(spark: SparkSession, text: str) -> DataFrame:
    return literal_rows(spark, [(text,)], "value string").coalesce(1)
