"""WARC archives: a deterministic sharded writer and a reader.

Shards are ranges of page ids that hold about SHARD_BYTES of payload, taken from an exact
histogram, so the same pages give the same files.  A task writes its shards in page order,
one gzip member per record with set headers and digests, and begins a new file when one has
reached its compressed size.  Files get a temporary name of their own attempt; Spark commits
the list of files of the attempts that succeeded (the manifest), and a second job gives
exactly these their final names.  A lost executor leaves only temporary files behind.

Of records with equal payloads the one with the largest page id is the response, the others
are revisits of it.  A null html is an empty payload; a null page id is always a response
and sorts first; repeated rows of one page id and payload are alike; an empty table gives no
files; a null or unfit url is replaced or escaped; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockspark.llm.common import column, stored, work_dir

SHARD_BYTES = 64 << 20
ROLL_BYTES = 32 << 20
#: Ranges of the histogram that shards are cut from.
BINS = 4096
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, seq int, temporary string, name string, records long, bytes long, sha1 string"
_MANIFEST = pa.schema([("shard", pa.int64()), ("seq", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
ROWS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(url: str | None, page: int | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page}"


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without a time stamp."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", _safe(url, page))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("X-Payload-Length", str(len(payload)))]
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return _member([*headers, ("Content-Type", "application/http;msgtype=response")], block)


def _info(name: str) -> bytes:
    block = b"software: stockspark\r\nformat: WARC File Format 1.1\r\n"
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def _store(path: str):
    """(file system, path in it) for tasks; any shared store that pyarrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class _Files:
    """The files of one task: rolled by compressed size and by shard."""

    def __init__(self, root: str, roll: int):
        self.fs, self.root = _store(root)
        self.roll, self.done, self.out = roll, [], None

    def add(self, shard: int, record: bytes) -> None:
        if self.out is not None and (shard != self.shard or self.size >= self.roll):
            self.close()
        if self.out is None:
            self.seq = self.done[-1]["seq"] + 1 if self.done and self.done[-1]["shard"] == shard else 0
            self.shard, self.size, self.records, self.sha = shard, 0, 0, hashlib.sha1()
            self.name = f"pages-{shard:06d}-{self.seq:05d}.warc.gz"
            self.temporary = f"_temporary/{uuid.uuid4().hex}-{self.name}"
            self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self._write(_info(self.name))
        self._write(record)
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None
            self.done.append({"shard": self.shard, "seq": self.seq, "temporary": self.temporary, "name": self.name, "records": self.records, "bytes": self.size, "sha1": self.sha.hexdigest()})


def write_warc(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives below ``root``; returns the manifest (shard, seq, temporary, name, records, bytes, sha1)."""
    spark = pages.sparkSession
    rows = pages.select(column(pages, page_id).cast("long").alias("page_id"), column(pages, url).alias("url"), F.coalesce(column(pages, html), F.lit("")).cast("binary").alias("payload"))
    light = rows.select("page_id", F.octet_length("payload").alias("n"), F.sha1("payload").alias("hex"))
    newest = light.groupBy("hex").agg(F.max("page_id").alias("response"))
    refs = stored(light.where(F.col("n") >= min_bytes).join(newest, "hex").where("page_id < response").select("page_id", "hex", "response").distinct(), "revisits")
    span = light.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    low, width = span["low"] or 0, ((span["high"] or 0) - (span["low"] or 0)) // BINS + 1
    in_bin = F.coalesce(F.floor((F.col("page_id") - low) / width), F.lit(-1)).cast("int")
    shards, shard, size = [], 0, 0
    for r in light.groupBy(in_bin.alias("bin")).agg(F.sum("n").alias("n")).orderBy("bin").collect():  # at most BINS + 2 rows
        if size and size + r["n"] > shard_bytes:
            shard, size = shard + 1, 0
        size += r["n"]
        shards.append((r["bin"], shard))
    if not shards:
        return spark.createDataFrame([], MANIFEST)
    cut = spark.createDataFrame(shards, "bin int, shard long")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, known = _Files(root, roll_bytes), None
        for batch in batches:
            for shard, page, hex_, response, url_, payload in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("shard", "page_id", "hex", "response", "url", "payload"))):
                key = (page.as_py(), hex_.as_py())
                if payload.as_py() is None:  # a revisit's note comes before its page
                    known = (key, response.as_py())
                    continue
                to = known[1] if known and known[0] == key else None
                files.add(shard.as_py(), page_record(key[0], url_.as_py(), payload.as_py(), to))
        files.close()
        yield pa.RecordBatch.from_pylist(files.done, schema=_MANIFEST)

    notes = refs.select("page_id", "hex", "response", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    both = notes.unionByName(rows.select("page_id", F.sha1("payload").alias("hex"), F.lit(None).cast("long").alias("response"), "url", "payload"))
    both = both.withColumn("bin", in_bin).join(F.broadcast(cut), "bin")
    dealt = both.repartition(max(1, shards[-1][1] + 1), "shard").sortWithinPartitions("shard", "page_id", "hex", F.col("payload").isNotNull(), "url")
    manifest = stored(dealt.mapInArrow(write, MANIFEST), "manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = _store(root)
        for batch in batches:
            for r in batch.to_pylist():
                if store.get_file_info(f"{base}/{r['temporary']}").type != fs.FileType.NotFound:  # else an earlier attempt moved it
                    store.move(f"{base}/{r['temporary']}", f"{base}/{r['name']}")
            yield batch

    return stored(manifest.mapInArrow(commit, MANIFEST), "committed")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an open archive, one gzip member at a time."""
    left = b""
    while True:
        left = left or stream.read(1 << 20)
        if not left:
            return
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not left:
                left = stream.read(1 << 20)
                if not left:
                    raise ValueError("the archive ends inside a record")
            parts.append(unpack.decompress(left))
            left = unpack.unused_data if unpack.eof else b""
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_warc(manifest: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of all records of the listed files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column(batch.schema.get_field_index("name")).to_pylist():
                out: list[dict] = []
                size = 0
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for h, block in records(stream):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        payload = block.partition(b"\r\n\r\n")[2]
                        if h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or h["WARC-Type"] == "response" and h["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
                            raise ValueError(f"digest of {h['WARC-Record-ID']} in {name}")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: E731, B023
                        full = len(payload) if h["WARC-Type"] == "response" else number("X-Payload-Length")
                        out.append({"page_id": number("X-Page-Id"), "url": h["WARC-Target-URI"], "payload_bytes": full, "payload_digest": h["WARC-Payload-Digest"][5:], "record_type": h["WARC-Type"], "refers_to": number("X-Refers-To-Page-Id"), "payload": payload if with_payload and h["WARC-Type"] == "response" else None})
                        size += len(payload) if with_payload else 200
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, size = [], 0
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    # a set number: Spark would otherwise merge these few names into one task
    return manifest.select("name").repartition(max(1, manifest.count()), "name").mapInArrow(read, ROWS)


def warc_digest(pages: DataFrame, **options) -> DataFrame:
    """Write the archives to a new shared folder and read them back."""
    root = work_dir(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, root, **options), root).drop("payload")
