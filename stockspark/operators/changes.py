"""Write endpoints re-aimed as batch jobs.

Common shape: ``op(snapshot, requests, ...) -> Result(snapshot, rejects, ...)``.
Requests carry an order column (``seq``, unique); the reference handles them
one at a time in arrival order and these jobs give the same end state.
Rejects are (seq, reason).  No table format with transactions is assumed:
the result is a new snapshot to write to a new directory.

Scale notes: duplicate checks are anti/semi joins on a normalised key;
"first request wins" is a per-key ``min(seq)`` aggregate (partial
aggregation, so a hot key is pre-combined map-side) joined back, not a
window over the hot key.  New ids use ``dense_number`` (no global window).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..plans.admission import admit
from ..plans.ordering import dense_number, monoid_fold
from ..plans.timeline import settle_names
from ..schemas import MONEY
from . import quality as Q


class _Lazy(Mapping):
    """Named frames; a function stands for a frame that is built when first asked for."""

    def __init__(self, frames: dict):
        self._frames = dict(frames)

    def __getitem__(self, key: str) -> DataFrame:
        if callable(self._frames[key]):
            self._frames[key] = self._frames[key]()
        return self._frames[key]

    def __iter__(self):
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)


class Result:
    """What a write job gives: the new ``snapshot``, the ``rejects`` and further frames in ``extra``.

    Parts that need jobs of their own (new ids) are only built when they are asked for.
    """

    def __init__(self, snapshot: DataFrame | Callable[[], DataFrame], rejects: DataFrame, extra: dict | None = None):
        self.rejects = rejects
        self.extra = _Lazy({"snapshot": snapshot, **(extra or {})})

    @property
    def snapshot(self) -> DataFrame:
        return self.extra["snapshot"]


def _reject(df: DataFrame, reason: Column | str) -> DataFrame:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return df.select(F.col("seq").cast("bigint").alias("seq"), r.alias("reason"))


def _union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _first_per_key(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Split requests into the first (lowest seq) per key and the later ones."""
    first = df.groupBy(key).agg(F.min("seq").alias("_first"))
    tagged = df.join(first, key)
    return (
        tagged.filter(F.col("seq") == F.col("_first")).drop("_first"),
        tagged.filter(F.col("seq") != F.col("_first")).drop("_first"),
    )


def _names_granted(table: DataFrame, req: DataFrame) -> DataFrame:
    """``seq`` of the requests (seq, id, _key) whose name no other row has at their turn (``plans.timeline``)."""
    holders = table.select("id", S.norm_name("name").alias("key"))
    return settle_names(holders, req.select("seq", "id", F.col("_key").alias("key"))).select("seq")


def _time(job_time: str | None) -> Column:
    """The moment of the job, or NULL where none is given."""
    return F.to_timestamp_ntz(F.lit(job_time)) if job_time is not None else F.lit(None).cast(T.TimestampNTZType())


def _once(build: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """``build``, called at most once."""
    return cache(build)


def _numbered(table: DataFrame, rows: DataFrame, order: str = "seq") -> DataFrame:
    """``rows`` with new ids behind the largest of ``table``, in ``order``."""
    largest = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return dense_number(rows, order, "id", start=int(largest))


# --------------------------------------------------------------- categories
def category_insert(categories: DataFrame, requests: DataFrame, job_time: str | None = None) -> Result:
    """Requests (seq, name, description); new rows are created at ``job_time``."""
    clean = F.trim(F.col("name"))
    req = requests.withColumn("_clean", clean)
    valid_len = F.coalesce(F.length("_clean").between(2, 50), F.lit(False))
    bad = req.filter(~valid_len)
    ok = req.filter(valid_len).withColumn("_esc", S.html_escape("_clean")).withColumn("_key", F.lower("_esc"))
    existing = categories.select(S.norm_name("name").alias("_key")).distinct()
    new = ok.join(existing, "_key", "left_anti")
    dup_existing = ok.join(existing, "_key", "left_semi")
    first, later = _first_per_key(new, "_key")
    added = _once(lambda: _numbered(categories, first).select(
        "id",
        F.col("_esc").alias("name"),
        S.blank_to_null("description").alias("description"),
        _time(job_time).alias("created_at"),
        "seq",
    ))
    rejects = _union_all([
        _reject(bad, "invalid_name"),
        _reject(dup_existing, "duplicate_name"),
        _reject(later, "duplicate_name"),
    ])
    return Result(lambda: categories.unionByName(added().drop("seq")), rejects, {"added": added})


def category_dedupe(categories: DataFrame, inventory: DataFrame) -> Result:
    """Keep the lowest id per LOWER(TRIM(name)); repoint inventory."""
    keyed = categories.withColumn("_key", S.norm_name("name"))
    keep = keyed.groupBy("_key").agg(F.min("id").alias("kept_id"))
    mapping = keyed.join(keep, "_key").select(F.col("id").alias("old_id"), "kept_id", "name")
    moved = mapping.filter(F.col("old_id") != F.col("kept_id"))
    snapshot = categories.join(moved.select(F.col("old_id").alias("id")), "id", "left_anti")
    remap = moved.select(F.col("old_id").alias("category_id"), "kept_id")
    inv = inventory.join(remap, "category_id", "left").withColumn(
        "category_id", F.coalesce("kept_id", "category_id")
    ).drop("kept_id").select(inventory.columns)
    no_rejects = moved.select(F.col("old_id").alias("seq"), F.lit("").alias("reason")).filter(F.lit(False))
    return Result(snapshot, no_rejects, {"mapping": moved, "inventory": inv})


def category_update(categories: DataFrame, requests: DataFrame) -> Result:
    """Requests (seq, id, name, description); the last request per id wins.

    A name is refused while another row has it, in ``seq`` order: names taken
    earlier in the batch count, names given up earlier are free.  Unknown ids
    are rejected.
    """
    req = requests.withColumn("_clean", F.trim("name")).withColumn("_key", F.lower("_clean"))
    missing = req.filter(F.col("_clean").isNull() | (F.col("_clean") == ""))
    req = req.filter(F.col("_clean").isNotNull() & (F.col("_clean") != ""))
    ids = categories.select("id")
    unknown = req.join(ids, "id", "left_anti")
    known = req.join(ids, "id", "left_semi")
    granted = _names_granted(categories, known)
    dup = known.join(granted, "seq", "left_anti")
    good = known.join(granted, "seq", "left_semi")
    last = good.groupBy("id").agg(F.max("seq").alias("seq"))
    chosen = good.join(last, ["id", "seq"]).select(
        "id", F.col("_clean").alias("_new_name"), S.blank_to_null("description").alias("_new_desc")
    )
    snapshot = (
        categories.join(chosen, "id", "left")
        .withColumn("name", F.coalesce("_new_name", "name"))
        .withColumn("description", F.when(F.col("_new_name").isNotNull(), F.col("_new_desc")).otherwise(F.col("description")))
        .select(categories.columns)
    )
    rejects = _union_all([_reject(missing, "invalid_name"), _reject(unknown, "not_found"), _reject(dup, "duplicate_name")])
    return Result(snapshot, rejects, {"changed": chosen})


def category_delete(categories: DataFrame, inventory: DataFrame, requests: DataFrame) -> Result:
    """Requests (seq, id); in-use and unknown ids and repeated deletes are rejected."""
    used = inventory.select(F.col("category_id").alias("id")).filter(F.col("id").isNotNull()).distinct()
    in_use = requests.join(categories.select("id"), "id", "left_semi").join(used, "id", "left_semi")
    first, not_found = _deletes(categories, requests.join(used, "id", "left_anti"))
    gone = requests.join(used, "id", "left_semi").join(categories.select("id"), "id", "left_anti")
    snapshot = categories.join(first.select("id"), "id", "left_anti")
    rejects = _union_all([not_found, _reject(gone, "not_found"), _reject(in_use, "in_use")])
    return Result(snapshot, rejects, {"deleted": first.select("seq", "id")})


# ---------------------------------------------------------------- inventory
def inventory_insert(inventory: DataFrame, requests: DataFrame, job_time: str | None = None) -> Result:
    """E5: requests with inventory columns + seq; F1 rules, then name checks; created and updated at ``job_time``."""
    checked = Q.check(requests, Q.INVENTORY_RULES)
    invalid = checked.filter(F.size("failed_rules") > 0)
    ok = checked.filter(F.size("failed_rules") == 0).withColumn("_trim", F.trim("name")).withColumn(
        "_key", F.lower("_trim")
    )
    existing = inventory.select(S.norm_name("name").alias("_key")).distinct()
    new = ok.join(existing, "_key", "left_anti")
    dup = ok.join(existing, "_key", "left_semi")
    first, later = _first_per_key(new, "_key")

    def rows() -> DataFrame:
        added = _numbered(inventory, first).withColumn("name", F.col("_trim"))
        now = {c: _time(job_time) for c in ("created_at", "updated_at")}
        cols = [now.get(f.name, F.col(f.name) if f.name in added.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in inventory.schema.fields]
        return added.select(*cols, "seq")

    added = _once(rows)
    rejects = _union_all([
        invalid.select(F.col("seq").cast("bigint").alias("seq"), F.concat(F.lit("invalid:"), F.array_join("failed_rules", ",")).alias("reason")),
        _reject(dup, "duplicate_name"),
        _reject(later, "duplicate_name"),
    ])
    return Result(lambda: inventory.unionByName(added().drop("seq")), rejects, {"added": added})


UPDATABLE_INVENTORY = ["name", "description", "category_id", "sku", "quantity", "min_quantity", "unit_price", "supplier", "location"]


def _merged_updates(requests: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """One row per id: every field that any of its requests sets, with the value of the last one (by seq) that sets it.

    One aggregate with map-side combine, so an id with very many requests is
    reduced before the shuffle.  ``more`` are further aggregates.
    """
    last = lambda c: F.max(F.when(F.array_contains("fields", c), F.struct("seq", F.col(f"new_{c}").alias("v"))))
    merged = requests.groupBy("id").agg(*[last(c).alias(f"_last_{c}") for c in columns], *more)
    fields = F.array_compact(F.array(*[F.when(F.col(f"_last_{c}").isNotNull(), F.lit(c)) for c in columns]))
    values = [F.col(f"_last_{c}.v").alias(f"new_{c}") for c in columns]
    kept = [c for c in merged.columns if not c.startswith("_last_") and c != "id"]
    return merged.select("id", fields.alias("fields"), *values, *kept)


def _partial_update(table: DataFrame, chosen: DataFrame, columns: list[str], touched_col: str | None, job_time: str | None) -> DataFrame:
    """Apply per-row partial updates: only fields listed in ``fields`` change."""
    j = table.join(chosen, "id", "left")
    out = []
    for f in table.schema.fields:
        c = f.name
        if c in columns:
            setv = F.coalesce(F.array_contains("fields", c), F.lit(False))
            out.append(F.when(setv, F.col(f"new_{c}").cast(f.dataType)).otherwise(F.col(c)).alias(c))
        elif c == touched_col and job_time is not None:
            out.append(
                F.when(F.col("fields").isNotNull(), F.to_timestamp_ntz(F.lit(job_time))).otherwise(F.col(c)).alias(c)
            )
        else:
            out.append(F.col(c))
    return j.select(*out)


def inventory_update(inventory: DataFrame, requests: DataFrame, job_time: str) -> Result:
    """Requests (seq, id, fields ARRAY<STRING>, new_<column>...).

    Only listed fields change; each field takes the value of the last request
    that sets it; a new name that another item has at that moment
    (case-insensitive, trimmed; in ``seq`` order) is rejected.
    """
    req = requests
    no_fields = req.filter(F.coalesce(F.size("fields"), F.lit(0)) <= 0)
    req = req.filter(F.coalesce(F.size("fields"), F.lit(0)) > 0)
    sets = lambda c: F.array_contains("fields", c)
    bad_value = (
        (sets("name") & F.coalesce(F.trim("new_name") == "", F.lit(True)))
        | (sets("quantity") & F.coalesce(F.col("new_quantity") < 0, F.lit(True)))
        | (sets("unit_price") & F.coalesce(F.col("new_unit_price") < 0, F.lit(True)))
    )
    invalid = req.filter(bad_value)
    req = req.filter(~bad_value)
    ids = inventory.select("id")
    unknown = req.join(ids, "id", "left_anti")
    known = req.join(ids, "id", "left_semi").withColumn("new_name", F.when(sets("name"), F.trim("new_name")))
    named = known.filter(sets("name")).select("seq", "id", F.lower("new_name").alias("_key"))
    refused = named.join(_names_granted(inventory, named), "seq", "left_anti")
    dup = known.join(refused, "seq", "left_semi")
    good = known.join(refused, "seq", "left_anti")
    merged = _merged_updates(good, UPDATABLE_INVENTORY)
    snapshot = _partial_update(inventory, merged, UPDATABLE_INVENTORY, "updated_at", job_time)
    rejects = _union_all([
        _reject(no_fields, "no_fields"),
        _reject(invalid, "invalid_value"),
        _reject(unknown, "not_found"),
        _reject(dup, "duplicate_name"),
    ])
    return Result(snapshot, rejects, {"applied": good.select("seq", "id")})


def _deletes(table: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first request per existing id, rejects): a later delete of the same id finds nothing."""
    ids = table.select("id")
    unknown = requests.join(ids, "id", "left_anti")
    first, later = _first_per_key(requests.join(ids, "id", "left_semi"), "id")
    return first, _reject(unknown.unionByName(later), "not_found")


def rows_delete(table: DataFrame, requests: DataFrame) -> Result:
    """Delete by id (inventory, staff, budget); unknown ids and repeated deletes are rejected."""
    _, rejects = _deletes(table, requests)
    snapshot = table.join(requests.select("id"), "id", "left_anti")
    return Result(snapshot, rejects)


# ------------------------------------------------------------ stock
# Each operation is a function q -> max(a, q + b) (a NULL = no floor, b NULL
# = constant a).  The family is closed under composition, so the ordered
# operations of one item fold associatively and can be split into groups.
_FN = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _op_fn(operation: Column, qty: Column) -> Column:
    q = qty.cast("bigint")
    a = F.when(operation == "subtract", F.lit(0).cast("bigint")).when(
        operation == "set", F.greatest(F.lit(0).cast("bigint"), q)
    )
    b = F.when(operation == "add", q).when(operation == "subtract", -q)
    return F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))


def _compose(acc: Column, f: Column) -> Column:
    """acc first, then f."""
    return F.struct(
        F.greatest(f["a"], acc["a"] + f["b"]).alias("a"),
        (acc["b"] + f["b"]).alias("b"),
    )


VALID_OPERATIONS = ["add", "subtract", "set"]


def stock_adjust(inventory: DataFrame, ops: DataFrame, job_time: str | None = None, width: int = 1 << 17) -> Result:
    """Ops (seq, item_id, operation, quantity), applied per item in seq order.

    add -> q + n (not clamped); subtract -> max(0, q - n); set -> max(0, n).
    Unknown items and invalid operations / quantities are rejected.
    """
    valid = F.col("operation").isin(*VALID_OPERATIONS) & F.col("quantity").isNotNull()
    invalid = ops.filter(~F.coalesce(valid, F.lit(False)))
    ops_ok = ops.filter(F.coalesce(valid, F.lit(False)))
    items = inventory.select(F.col("id").alias("item_id"))
    unknown = ops_ok.join(items, "item_id", "left_anti")
    applied = ops_ok.join(items, "item_id", "left_semi").select(
        "item_id", "seq", _op_fn(F.col("operation"), F.col("quantity")).alias("f")
    )
    # Cast to a struct with nullable fields: a literal 0 would make ``b``
    # non-nullable and the fold would silently turn NULL (constant) into 0.
    identity = F.struct(F.lit(None).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).cast(_FN)
    folded = monoid_fold(
        applied.select("item_id", "seq", F.col("f.a").alias("a"), F.col("f.b").alias("b")),
        "item_id",
        "seq",
        ["a", "b"],
        identity,
        _compose,
        width,
    ).select(F.col("item_id").alias("_iid"), F.col("acc.a").alias("_a"), F.col("acc.b").alias("_b"))
    j = inventory.join(folded, inventory.id == folded._iid, "left")
    new_q = F.greatest(F.col("_a"), F.col("quantity").cast("bigint") + F.col("_b")).cast("int")
    touched = F.col("_iid").isNotNull()
    cols = []
    for c in inventory.columns:
        if c == "quantity":
            cols.append(F.when(touched, new_q).otherwise(F.col("quantity")).alias("quantity"))
        elif c == "updated_at" and job_time is not None:
            cols.append(F.when(touched, F.to_timestamp_ntz(F.lit(job_time))).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    snapshot = j.select(*cols)
    rejects = _union_all([_reject(invalid, "invalid_request"), _reject(unknown, "item_not_found")])
    return Result(snapshot, rejects)


# ------------------------------------------------------------- sales
def sale_post(
    inventory: DataFrame, requests: DataFrame, job_time: str | None = None, sales: DataFrame | None = None, slice_rows: int | None = None
) -> Result:
    """Sale requests applied per item in (requested_at, request_id) order.

    Requests failing the F2 rules are rejected as 'invalid:<rules>'.  A valid
    request is accepted when the item exists and its current stock covers
    the quantity; the stock then drops and the item is updated at
    ``job_time``.  Returns the new inventory snapshot (``snapshot``), the
    items that changed (``changed``), rejects, ``outcomes`` (request_id,
    item_id, status) and ``accepted`` sales rows (total_price = quantity *
    unit_price), numbered behind ``sales`` where that table is given.

    Requests asking for more than the starting stock can never pass (stock
    only falls), so they are rejected before any ordering work; the others
    are admitted in order by ``plans.admission``, where no task holds an
    item's requests.  That runs once, however many results are used.
    """
    stock = inventory.select(F.col("id").alias("item_id"), F.col("quantity").alias("_q0"))
    tagged = Q.check(requests, Q.SALES_RULES).join(stock, "item_id", "left").withColumn(
        "_st0",
        F.when(F.size("failed_rules") > 0, F.concat(F.lit("invalid:"), F.array_join("failed_rules", ",")))
        .when(F.col("_q0").isNull(), F.lit("item_not_found"))
        .when(~F.coalesce(F.col("quantity") <= F.col("_q0"), F.lit(False)), F.lit("insufficient_stock")),
    )
    decided = tagged.filter(F.col("_st0").isNotNull()).select("request_id", "item_id", F.col("_st0").alias("status"))
    judged = admit(tagged.filter(F.col("_st0").isNull()).withColumn("stock", F.col("_q0")), slice_rows)
    status = F.when(F.col("accepted"), F.lit("accepted")).otherwise(F.lit("insufficient_stock"))
    outcomes = decided.unionByName(judged.select("request_id", "item_id", status.alias("status")))
    passed = judged.filter("accepted")
    sold = passed.groupBy(F.col("item_id").alias("id")).agg(F.sum("quantity").alias("_sold"))

    def after(how: str) -> DataFrame:
        now = {"quantity": (F.col("quantity") - F.col("_sold")).cast("int")}
        if job_time is not None:
            now["updated_at"] = _time(job_time)
        cols = [F.when(F.col("_sold").isNotNull(), now[c]).otherwise(F.col(c)).alias(c) if c in now else F.col(c) for c in inventory.columns]
        return inventory.join(sold, "id", how).select(*cols)

    def accepted() -> DataFrame:
        rows = requests.join(passed.select("item_id", "request_id"), ["item_id", "request_id"], "left_semi")
        if sales is None:
            rows = rows.withColumn("id", F.col("request_id"))
        else:
            rows = _numbered(sales, rows.withColumn("_turn", F.struct("requested_at", "request_id")), "_turn")
        return rows.select(
            "id",
            "item_id",
            "quantity",
            "unit_price",
            (F.col("quantity") * F.col("unit_price")).cast(MONEY).alias("total_price"),
            "customer_name",
            "customer_phone",
            "staff_id",
            F.col("requested_at").alias("sale_date"),
            "payment_method",
            "notes",
        )

    rejects = outcomes.filter(F.col("status") != "accepted").select(
        F.col("request_id").alias("seq"), F.col("status").alias("reason")
    )
    return Result(lambda: after("left"), rejects, {"outcomes": outcomes, "accepted": accepted, "changed": lambda: after("inner")})


def sale_update(sales: DataFrame, requests: DataFrame) -> Result:
    """Requests (seq, id, fields, new_quantity, new_unit_price, new_customer_name, ...).

    Requests of one sale apply in seq order, each to the fields it lists.
    When quantity or unit_price is supplied and non-zero, total_price =
    (new or current quantity) x (new non-zero or current price).  A
    unit_price of 0 is written but not used for that request's total.
    Stock is not adjusted.
    """
    no_fields = requests.filter(F.coalesce(F.size("fields"), F.lit(0)) <= 0)
    req = requests.filter(F.coalesce(F.size("fields"), F.lit(0)) > 0)
    sets = lambda c: F.coalesce(F.array_contains("fields", c), F.lit(False))
    bad = (sets("quantity") & F.coalesce(F.col("new_quantity") < 1, F.lit(True))) | (
        sets("unit_price") & F.coalesce(F.col("new_unit_price") < 0, F.lit(True))
    )
    invalid = req.filter(bad)
    req = req.filter(~bad)
    ids = sales.select("id")
    unknown = req.join(ids, "id", "left_anti")
    known = req.join(ids, "id", "left_semi")
    # the last request that computes a total, and the price that is current just before it
    computes = sets("quantity") | (sets("unit_price") & (F.col("new_unit_price") != 0))
    at = req.filter(computes).groupBy("id").agg(F.max("seq").alias("_at"))
    own = F.when((F.col("seq") == F.col("_at")) & sets("unit_price") & (F.col("new_unit_price") != 0), F.col("new_unit_price"))
    before = F.when((F.col("seq") < F.col("_at")) & sets("unit_price"), F.struct("seq", F.col("new_unit_price").alias("v")))
    cols = ["quantity", "unit_price", "customer_name", "customer_phone", "staff_id", "sale_date", "payment_method", "notes", "item_id"]
    merged = _merged_updates(
        req.join(at, "id", "left"), cols, F.max("_at").alias("_at"), F.max(own).alias("_own"), F.max(before).alias("_before")
    )
    used = F.struct(
        F.col("_at").isNotNull().alias("given"),
        F.when(F.array_contains("fields", "quantity"), F.col("new_quantity")).alias("q"),
        F.coalesce("_own", F.col("_before.v")).alias("p"),
    )
    j = sales.join(merged.withColumn("_used", used).drop("_at", "_own", "_before"), "id", "left")
    total = F.coalesce("_used.q", "quantity") * F.coalesce("_used.p", "unit_price")
    final = {c: F.when(F.array_contains("fields", c), F.col(f"new_{c}").cast(sales.schema[c].dataType)).otherwise(F.col(c)) for c in cols}
    final["total_price"] = F.when(F.col("_used.given"), total.cast(MONEY)).otherwise(F.col("total_price"))
    snapshot = j.select(*[final.get(c, F.col(c)).alias(c) for c in sales.columns])
    rejects = _union_all([_reject(no_fields, "no_fields"), _reject(invalid, "invalid_value"), _reject(unknown, "not_found")])
    return Result(snapshot, rejects, {"applied": known.select("seq", "id")})


def sale_delete(sales: DataFrame, inventory: DataFrame, requests: DataFrame, job_time: str | None = None) -> Result:
    """Requests (seq, id); deleted quantities go back to their items, which are updated at ``job_time``."""
    _, rejects = _deletes(sales, requests)
    gone = sales.join(requests.select("id").distinct(), "id", "left_semi")
    back = gone.groupBy("item_id").agg(F.sum("quantity").alias("_back"))
    now = {"quantity": (F.col("quantity") + F.coalesce("_back", F.lit(0))).cast("int")}
    if job_time is not None:
        now["updated_at"] = _time(job_time)
    cols = [F.when(F.col("_item").isNotNull(), now[c]).otherwise(F.col(c)).alias(c) if c in now else F.col(c) for c in inventory.columns]
    inv = inventory.join(back.withColumnRenamed("item_id", "_item"), F.col("id") == F.col("_item"), "left").select(*cols)
    snapshot = sales.join(requests.select("id"), "id", "left_anti")
    return Result(snapshot, rejects, {"inventory": inv})


# -------------------------------------------------------------------- staff
# Fixed accepted date layouts for hire_date, tried in this order.
HIRE_DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "MMMM d, yyyy", "MMM d, yyyy"]


def parse_hire_date(c: Column) -> Column:
    """Text -> DATE or NULL when no layout fits."""
    text = F.trim(c.cast("string"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(fmt))) for fmt in HIRE_DATE_FORMATS])


def staff_insert(staff: DataFrame, requests: DataFrame, job_time: str | None = None) -> Result:
    """Requests (seq, name, email, phone, position, department, hire_date text, salary text); created at ``job_time``."""
    text = F.nullif(F.trim(F.col("salary").cast("string")), F.lit(""))
    req = requests.withColumn("_no_number", text.isNotNull() & text.try_cast(MONEY).isNull()).withColumn("salary", text.try_cast(MONEY))
    checked = Q.check(req, [*Q.STAFF_RULES, ("salary_number", lambda: F.col("_no_number"))]).drop("_no_number")
    invalid = checked.filter(F.size("failed_rules") > 0)
    ok = checked.filter(F.size("failed_rules") == 0).withColumn("_email", F.lower(F.trim("email")))
    taken = staff.select(F.lower(F.trim("email")).alias("_email")).filter(F.col("_email").isNotNull()).distinct()
    with_email = ok.filter(F.col("_email").isNotNull())
    no_email = ok.filter(F.col("_email").isNull())
    dup = with_email.join(taken, "_email", "left_semi")
    fresh = with_email.join(taken, "_email", "left_anti")
    first, later = _first_per_key(fresh, "_email")
    accepted = first.drop("_email").unionByName(no_email.drop("_email"))
    added = _once(lambda: _numbered(staff, accepted).select(
        "id",
        "name",
        "email",
        "phone",
        "position",
        "department",
        parse_hire_date(F.col("hire_date")).alias("hire_date"),
        "salary",
        F.lit("active").alias("status"),
        _time(job_time).alias("created_at"),
        "seq",
    ))
    rejects = _union_all([
        invalid.select(F.col("seq").cast("bigint").alias("seq"), F.concat(F.lit("invalid:"), F.array_join("failed_rules", ",")).alias("reason")),
        _reject(dup, "duplicate_email"),
        _reject(later, "duplicate_email"),
    ])
    return Result(lambda: staff.unionByName(added().drop("seq")), rejects, {"added": added})


UPDATABLE_STAFF = ["name", "email", "phone", "position", "department", "hire_date", "salary", "status"]


def staff_update(staff: DataFrame, requests: DataFrame) -> Result:
    """Partial update by id (no duplicate-name check); each field takes its last request's value."""
    no_fields = requests.filter(F.coalesce(F.size("fields"), F.lit(0)) <= 0)
    req = requests.filter(F.coalesce(F.size("fields"), F.lit(0)) > 0)
    sets = lambda c: F.coalesce(F.array_contains("fields", c), F.lit(False))
    bad = (
        (sets("name") & F.coalesce(F.trim("new_name") == "", F.lit(True)))
        | (sets("email") & ~F.coalesce(F.col("new_email").rlike(Q.EMAIL_PATTERN), F.lit(False)))
        | (sets("salary") & F.coalesce(F.col("new_salary") < 0, F.lit(True)))
    )
    invalid = req.filter(bad)
    req = req.filter(~bad)
    ids = staff.select("id")
    unknown = req.join(ids, "id", "left_anti")
    known = req.join(ids, "id", "left_semi")
    snapshot = _partial_update(staff, _merged_updates(req, UPDATABLE_STAFF), UPDATABLE_STAFF, None, None)
    rejects = _union_all([_reject(no_fields, "no_fields"), _reject(invalid, "invalid_value"), _reject(unknown, "not_found")])
    return Result(snapshot, rejects, {"applied": known.select("seq", "id")})


STAFF_STATUSES = ["active", "inactive", "terminated"]


def staff_status_update(staff: DataFrame, requests: DataFrame) -> Result:
    """Requests (seq, id, status); status must be one of STAFF_STATUSES."""
    bad = requests.filter(~F.coalesce(F.col("status").isin(*STAFF_STATUSES), F.lit(False)))
    ok = requests.filter(F.coalesce(F.col("status").isin(*STAFF_STATUSES), F.lit(False)))
    ids = staff.select("id")
    unknown = ok.join(ids, "id", "left_anti")
    known = ok.join(ids, "id", "left_semi")
    last = known.groupBy("id").agg(F.max("seq").alias("seq"))
    chosen = known.join(last, ["id", "seq"]).select("id", F.col("status").alias("_new_status"))
    snapshot = (
        staff.join(chosen, "id", "left").withColumn("status", F.coalesce("_new_status", "status")).select(staff.columns)
    )
    rejects = _union_all([_reject(bad, "invalid_status"), _reject(unknown, "not_found")])
    return Result(snapshot, rejects)


# ------------------------------------------------------------------- budget
def budget_insert(budget: DataFrame, requests: DataFrame, job_time: str | None = None) -> Result:
    """Requests (seq, category, amount, spent, month_year text).

    Stored month is normalised to 'YYYY-MM'; (category, month) must be new.
    New rows are created at ``job_time``.
    """
    y, m = S.parse_month_year(F.col("month_year"))
    req = requests.withColumn("_y", y).withColumn("_m", m)
    checked = Q.check(req, Q.BUDGET_RULES)
    invalid = checked.filter(F.size("failed_rules") > 0)
    ok = checked.filter(F.size("failed_rules") == 0)
    bad_month = ok.filter(F.col("_y").isNull() | ~F.coalesce(F.col("_m").between(1, 12), F.lit(False)))
    ok = ok.filter(F.col("_y").isNotNull() & F.coalesce(F.col("_m").between(1, 12), F.lit(False)))
    ok = ok.withColumn("_ym", S.format_month_year("_y", "_m")).withColumn("_key", F.concat_ws("|", "category", "_ym"))
    taken = budget.select(F.concat_ws("|", "category", "month_year").alias("_key")).distinct()
    dup = ok.join(taken, "_key", "left_semi")
    fresh = ok.join(taken, "_key", "left_anti")
    first, later = _first_per_key(fresh, "_key")
    added = _once(lambda: _numbered(budget, first).select(
        "id",
        "category",
        F.col("amount").cast(MONEY).alias("amount"),
        F.coalesce(F.col("spent").cast(MONEY), F.lit(0).cast(MONEY)).alias("spent"),
        F.col("_ym").alias("month_year"),
        _time(job_time).alias("created_at"),
        "seq",
    ))
    rejects = _union_all([
        invalid.select(F.col("seq").cast("bigint").alias("seq"), F.concat(F.lit("invalid:"), F.array_join("failed_rules", ",")).alias("reason")),
        _reject(bad_month, "invalid_month"),
        _reject(dup, "duplicate_budget"),
        _reject(later, "duplicate_budget"),
    ])
    return Result(lambda: budget.unionByName(added().drop("seq")), rejects, {"added": added})


def budget_update(budget: DataFrame, requests: DataFrame) -> Result:
    """Partial update (amount, spent, category, month_year); amounts >= 0."""
    no_fields = requests.filter(F.coalesce(F.size("fields"), F.lit(0)) <= 0)
    req = requests.filter(F.coalesce(F.size("fields"), F.lit(0)) > 0)
    sets = lambda c: F.coalesce(F.array_contains("fields", c), F.lit(False))
    bad = (sets("amount") & F.coalesce(F.col("new_amount") < 0, F.lit(True))) | (
        sets("spent") & F.coalesce(F.col("new_spent") < 0, F.lit(True))
    )
    invalid = req.filter(bad)
    req = req.filter(~bad)
    ids = budget.select("id")
    unknown = req.join(ids, "id", "left_anti")
    known = req.join(ids, "id", "left_semi")
    columns = ["category", "amount", "spent", "month_year"]
    snapshot = _partial_update(budget, _merged_updates(req, columns), columns, None, None)
    rejects = _union_all([_reject(no_fields, "no_fields"), _reject(invalid, "invalid_value"), _reject(unknown, "not_found")])
    return Result(snapshot, rejects, {"applied": known.select("seq", "id")})


def transaction_post(budget: DataFrame, transactions: DataFrame, requests: DataFrame) -> Result:
    """Requests (seq, type, amount, description, category, date, staff_id).

    Valid requests are appended to ``transactions`` with new ids, in ``seq``
    order; every expense adds its amount to the budget row of (category,
    month of the transaction date).  No matching budget -> no budget change.
    Expenses are summed per (category, month) before the join, so the budget
    join sees one row per key.  ``posted`` has the new rows with their seq,
    ``transactions`` the whole new table.
    """
    checked = Q.check(requests, Q.TRANSACTION_RULES)
    invalid = checked.filter(F.size("failed_rules") > 0)
    ok = checked.filter(F.size("failed_rules") == 0).drop("failed_rules")
    spend = (
        ok.filter(F.col("type") == "expense")
        .groupBy("category", S.month_year("date").alias("month_year"))
        .agg(F.sum("amount").alias("_add"))
    )
    snapshot = (
        budget.join(spend, ["category", "month_year"], "left")
        .withColumn("spent", (F.col("spent") + F.coalesce("_add", F.lit(0))).cast(MONEY))
        .select(budget.columns)
    )
    posted = _once(lambda: _numbered(transactions, ok).select(
        "id", "type", F.col("amount").cast(MONEY).alias("amount"), "description", "category", "date", "staff_id", "seq"
    ))
    rejects = invalid.select(F.col("seq").cast("bigint").alias("seq"), F.concat(F.lit("invalid:"), F.array_join("failed_rules", ",")).alias("reason"))
    return Result(snapshot, rejects, {"posted": posted, "transactions": lambda: transactions.unionByName(posted().drop("seq"))})


# ---------------------------------------------------------------- E18 remap
def remap_categories(inventory: DataFrame, categories: DataFrame, mapping: DataFrame, default_category: str) -> DataFrame:
    """Assign categories by exact item name; uncategorised items get a default.

    ``mapping`` is (item_name, category_name).  Returns only changed rows
    (id, name, old_category_id, new_category_id).  Both look-ups are joins on
    a key (the mapping can be large); no driver-side dictionary.
    """
    cats = categories.select(F.col("id").alias("_cid"), F.col("name").alias("_cname"))
    current = inventory.join(cats, inventory.category_id == cats._cid, "left")
    # one id per category name (names are not unique in every store)
    by_name = cats.groupBy("_cname").agg(F.max("_cid").alias("_cid"))
    m = mapping.join(by_name, mapping.category_name == by_name._cname).select(
        F.col("item_name").alias("_mname"), F.col("_cid").alias("_mapped")
    )
    m = m.groupBy("_mname").agg(F.max("_mapped").alias("_mapped"))
    # One number: the id of the default category.
    default_id = categories.filter(F.col("name") == default_category).agg(F.min("id")).first()[0]
    j = current.join(m, current.name == m._mname, "left").withColumn("_default", F.lit(default_id).cast("bigint"))
    uncategorised = F.col("_cname").isNull() | (F.col("_cname") == "N/A")
    new = F.when(F.col("_mapped").isNotNull(), F.col("_mapped")).when(uncategorised, F.col("_default")).otherwise(
        F.col("category_id")
    )
    return j.select(
        "id", "name", F.col("category_id").alias("old_category_id"), new.alias("new_category_id")
    ).filter(~F.col("old_category_id").eqNullSafe(F.col("new_category_id")))
