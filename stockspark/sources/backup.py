"""Sources, sinks and table utilities.

Backups are directories: ``<root>/data/<table>/`` holds JSON lines written by
every task in parallel, ``<root>/manifest/`` one line per table (timestamp,
version, source, table, rows, digest).  Nothing passes through the driver.
Backups in one JSON document are read and written by ``sources.document``.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..schemas import BACKUP_TABLES, CATEGORIES, INVENTORY, TABLE_SCHEMAS
from ..plans.ordering import dense_number
from .fixtures import literal_rows

BACKUP_VERSION = "1.0"
CORRUPT = "_corrupt_record"


def _union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# A1
def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, count) for the five backup tables plus a '__total__' row."""
    counts = _union_all([
        tables[name].agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("table"), "count")
        for name in BACKUP_TABLES
    ])
    total = counts.agg(F.sum("count").cast("bigint").alias("count")).select(F.lit("__total__").alias("table"), "count")
    return counts.unionByName(total)


# A2
def table_preview(tables: dict[str, DataFrame], name: str, k: int = 100) -> DataFrame:
    """First ``k`` rows by id of an allow-listed table; other names raise."""
    if name not in BACKUP_TABLES:
        raise ValueError(f"invalid table name: {name!r}")
    return tables[name].orderBy("id").limit(k)


# A3
def backup_records(tables: dict[str, DataFrame]) -> DataFrame:
    """Every row of the backup tables as (table, record JSON), NULLs kept."""
    return _union_all([
        tables[name].select(F.lit(name).alias("table"), _record(tables[name]).alias("record"))
        for name in BACKUP_TABLES
    ])


def _record(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def _digest(record: Column) -> list:
    """Rows and an order-free digest of the records: two sums of 64-bit hashes, so every cell and every copy counts."""
    return [
        F.count(F.lit(1)).alias("rows"),
        _wide_sum(F.xxhash64(record)).cast("string").alias("a"),
        _wide_sum(F.xxhash64(F.concat(record, F.lit("#")))).cast("string").alias("b"),
    ]


def _wide_sum(number: Column) -> Column:
    """The exact sum of 64-bit numbers (0 without rows), added as longs in three parts: a decimal for each row is slow."""
    low = (1 << 21) - 1
    parts = (F.shiftright(number, 42), F.shiftright(number, 21).bitwiseAND(low), number.bitwiseAND(low))
    top, middle, last = (F.coalesce(F.sum(p), F.lit(0)).cast("decimal(20,0)") for p in parts)
    scale = lambda bits: F.lit(1 << bits).cast("decimal(13,0)")
    return top * scale(42) + middle * scale(21) + last


#: Records of a compressed file: only one task can read it.
COMPRESSED_RECORDS = 500_000


def write_backup(
    tables: dict[str, DataFrame], root: str, source: str = "stockspark", timestamp: str | None = None, compression: str = "none"
) -> DataFrame:
    """Write each table as JSON lines under root/data/<table> and a manifest.

    Rows and digest of a table are observed while it is written; nothing is
    read again, and each record is put into JSON once.  ``compression`` is that
    of the JSON lines ("gzip"); reading goes by the files' names.  Returns the
    manifest DataFrame (timestamp, version, source, table, rows, digest).
    """
    spark = next(iter(tables.values())).sparkSession
    ts = timestamp or dt.datetime.now(dt.timezone.utc).isoformat()
    lines = []
    for name in BACKUP_TABLES:
        seen = Observation(f"backup-{name}-{uuid.uuid4().hex}")
        watched = tables[name].select(_record(tables[name]).alias("value")).observe(seen, *_digest(F.col("value")))
        files = watched.write.mode("overwrite").option("compression", compression)
        if compression != "none":
            files = files.option("maxRecordsPerFile", COMPRESSED_RECORDS)
        files.text(f"{root}/data/{name}")
        got = seen.get
        lines.append((ts, BACKUP_VERSION, source, name, got["rows"], f"{got['a']}:{got['b']}"))
    manifest = literal_rows(spark, lines, "timestamp string, version string, source string, table string, rows bigint, digest string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return spark.read.schema(manifest.schema).json(f"{root}/manifest")


def verify_backup(spark: SparkSession, root: str) -> DataFrame:
    """(table, rows, expected, intact): the restored rows of a backup directory against its manifest, content included."""
    frames, _ = read_backup(spark, root)
    manifest = spark.read.json(f"{root}/manifest").select("table", F.col("rows").alias("expected"), "digest")
    now = _union_all([
        df.agg(*_digest(_record(df))).select(F.lit(name).alias("table"), "rows", F.concat_ws(":", "a", "b").alias("found")) for name, df in frames.items()
    ])
    same = F.coalesce((F.col("rows") == F.col("expected")) & (F.col("found") == F.col("digest")), F.col("expected") == 0)
    return manifest.join(now, "table", "left").select("table", F.coalesce("rows", F.lit(0)).alias("rows"), "expected", same.alias("intact"))


# A4
def _first_record_keys(spark: SparkSession, path: str) -> list[str] | None:
    """Keys of the first record of a table folder; None when absent or empty."""
    from pyspark.errors import AnalysisException

    try:
        first = spark.read.text(path).limit(1).collect()  # one line
    except AnalysisException:  # no such folder
        return None
    if not first:
        return None
    try:
        return list(json.loads(first[0][0]).keys())
    except ValueError:
        return None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The records of a table folder; none where the folder is absent."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path)
    except AnalysisException:  # no such folder
        return spark.createDataFrame([], "value string")


def restored(lines: DataFrame, name: str, keys: list[str] | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows, status line) of a table from its records, one JSON text (``value``) each.

    Records are parsed with the table's schema in PERMISSIVE mode; those that
    do not parse are skipped and counted.  Columns not in ``keys`` (None: all)
    become NULL.  Unknown tables and tables without records are 'skipped'.
    """
    spark = lines.sparkSession
    layout = "table string, status string, restored bigint, total bigint"
    if name not in BACKUP_TABLES or lines.isEmpty():
        return None, literal_rows(spark, [(name, "skipped", 0, 0)], layout)
    schema = TABLE_SCHEMAS[name]
    read_schema = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    # a record that is not valid JSON or does not fit the schema lands in the corrupt column
    # (inline: filters stay above it, so a record is parsed once and not for the filter too)
    parsed = F.from_json("value", read_schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    raw = lines.select(F.inline(F.array(parsed)))
    good = raw.filter(F.col(CORRUPT).isNull()).select(
        *[(F.col(f.name) if keys is None or f.name in keys else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]
    )
    counts = raw.agg(F.count_if(F.col(CORRUPT).isNull()).alias("restored"), F.count(F.lit(1)).alias("total"))
    return good, counts.select(F.lit(name).alias("table"), F.lit("completed").alias("status"), "restored", "total")


def read_backup(
    spark: SparkSession, root: str, tables: list[str] | None = None, own_keys: bool = True
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Restore tables from a backup directory.

    Every record is restored by its own keys; with ``own_keys=False`` only
    the keys of the table's first record are restored, as the reference does
    (other columns become NULL).  See ``restored`` for the rest.
    Returns ({table: DataFrame}, status(table, status, restored, total)).
    """
    names = tables
    if names is None:
        man = spark.read.json(f"{root}/manifest").select("table").collect()  # one row per table
        names = [r[0] for r in man]
    frames: dict[str, DataFrame] = {}
    status = []
    for name in names:
        path = f"{root}/data/{name}"
        lines = _lines(spark, path)
        keys = None if own_keys else _first_record_keys(spark, path)
        if not own_keys and keys is None:
            lines = lines.limit(0)
        frame, line = restored(lines, name, keys)
        if frame is not None:
            frames[name] = frame
        status.append(line)
    return frames, _union_all(status)


# A5
def round_trip_diff(tables: dict[str, DataFrame], restored: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows lost and rows gained by export + restore (both 0 when equal).

    One grouped pass per table: originals weigh +1, restored rows -1; any
    row value whose weights do not cancel is a difference (NULL-safe).
    """
    parts = []
    for name in BACKUP_TABLES:
        cols = tables[name].columns
        both = tables[name].withColumn("_w", F.lit(1)).unionByName(
            restored[name].select(*cols).withColumn("_w", F.lit(-1))
        )
        d = both.groupBy(*cols).agg(F.sum("_w").alias("_d"))
        parts.append(
            d.agg(
                F.coalesce(F.sum(F.when(F.col("_d") > 0, F.col("_d"))), F.lit(0)).cast("bigint").alias("missing"),
                F.coalesce(F.sum(F.when(F.col("_d") < 0, -F.col("_d"))), F.lit(0)).cast("bigint").alias("extra"),
            ).select(F.lit(name).alias("table"), "missing", "extra")
        )
    return _union_all(parts)


# A6
def _conform_checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    casts, fails = [], []
    for f in schema.fields:
        if f.name in df.columns:
            src = F.col(f.name)
            conv = src.try_cast(f.dataType)
            casts.append(conv.alias(f.name))
            fails.append(F.when(src.isNotNull() & conv.isNull(), F.lit(f.name)))
        else:
            casts.append(F.lit(None).cast(f.dataType).alias(f.name))
    bad = F.filter(F.array(*fails), lambda x: x.isNotNull()) if fails else F.array().cast("array<string>")
    return df.select(*casts, bad.alias("_bad"))


def conform_to_schema(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Cast each target column with try_cast; a row fails when a non-NULL value does not convert.

    Missing source columns become NULL.  Returns (good rows, rejected rows with
    the failing column names).
    """
    checked = _conform_checked(df, schema)
    good = checked.filter(F.size("_bad") == 0).drop("_bad")
    rejected = checked.filter(F.size("_bad") > 0).withColumnRenamed("_bad", "failed_columns")
    return good, rejected


def budget_as_form_b(budget: DataFrame) -> DataFrame:
    """Budget rows in the (category, month, year) layout; month text parsed by G1."""
    y, m = S.parse_month_year(F.col("month_year"))
    return budget.select(
        "id",
        "category",
        F.col("amount").alias("allocated_amount"),
        F.col("spent").alias("spent_amount"),
        m.alias("month"),
        y.alias("year"),
        "created_at",
    )


def as_text(df: DataFrame) -> DataFrame:
    """Every column as STRING (how rows arrive from a text-typed store)."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


# A7
# The default categories, in seeding order.
DEFAULT_CATEGORIES = [
    "Plumbing Supplies",
    "Electrical Supplies",
    "Tools",
    "Fasteners",
    "Pipes & Fittings",
    "Valves",
    "Pumps",
    "Safety Equipment",
    "Other",
]


def seed_categories(categories: DataFrame) -> DataFrame:
    """Categories plus the defaults that are absent (by LOWER(TRIM(name)))."""
    spark = categories.sparkSession
    defaults = literal_rows(spark, list(enumerate(DEFAULT_CATEGORIES)), "seq bigint, name string")
    existing = categories.select(S.norm_name("name").alias("_key")).distinct()
    missing = defaults.withColumn("_key", S.norm_name("name")).join(existing, "_key", "left_anti").drop("_key")
    mx = categories.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = dense_number(missing, "seq", "id", start=int(mx)).select(
        "id", "name", F.lit(None).cast("string").alias("description"), F.lit(None).cast(T.TimestampNTZType()).alias("created_at")
    )
    return categories.unionByName(added.select([f.name for f in CATEGORIES.fields]))


# A8
# Column renames and added columns of the older inventory layout.
INVENTORY_RENAMES = {"minimum_stock": "min_quantity"}
INVENTORY_DEFAULTS = {"min_quantity": 0}


def column_evolution(old: DataFrame) -> DataFrame:
    """Bring an older inventory table to the current schema.

    Renames minimum_stock -> min_quantity; adds missing columns (min_quantity
    0, the others NULL); columns are cast to the current types.
    """
    df = old
    for src, dst in INVENTORY_RENAMES.items():
        if src in df.columns and dst not in df.columns:
            df = df.withColumnRenamed(src, dst)
    cols = []
    for f in INVENTORY.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            default = INVENTORY_DEFAULTS.get(f.name)
            cols.append(F.lit(default).cast(f.dataType).alias(f.name))
    return df.select(*cols)
