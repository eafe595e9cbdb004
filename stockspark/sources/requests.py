"""Request batches for the write jobs, derived by Spark from the driver tables.

Each builder returns one request per source row (so the batch grows with the
data) and mixes accepted, duplicate, invalid and unknown-id cases.  The same
definitions are written as DuckDB CTEs in ``plans.fixture_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.raw_bodies import RAW_BODIES
from ..schemas import MONEY
from .fixtures import DUPLICATE_IDS, Tables

# Fixed values of the request mapping (shared with the oracle).
JOB_TIME = "2024-02-01 00:00:00"
NEW_SUPPLIER = "Acme"
NEW_LOCATION = "Dock"
REMAP_DEFAULT = "Valves"


# Fixed value: added to the seq of an id's second request; above the first seq of that id.
REPEAT_SEQ = 10**18


def _arr(*names: str) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast(T.ArrayType(T.StringType()))


def _nulls(df: DataFrame, cols: dict[str, T.DataType]) -> DataFrame:
    for c, t in cols.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(t))
    return df


def category_requests(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = (
        F.when(k % 4 == 0, F.col("p_type"))
        .when(k % 4 == 1, F.col("p_brand"))
        .when(k % 4 == 2, F.concat(F.lit("  "), F.lower("p_brand"), F.lit(" ")))
        .when(k % 8 == 3, F.lit("x"))
        .otherwise(F.concat(F.col("p_brand"), F.lit(" & Co")))
    )
    return t.raw("part").select(k.alias("seq"), name.alias("name"), F.col("p_name").alias("description"))


def category_update_requests(t: Tables) -> DataFrame:
    """Renames; then every category asks for the name that the one before had first; then many ask for one name."""
    d = t.categories_dirty
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lower(F.trim("name")), F.lit(" line"))).otherwise(F.lit("pumps"))
    renames = d.select(F.col("id").alias("seq"), "id", name.alias("name"), F.lit("updated").alias("description"))
    shifted = t.categories.select((F.col("id") + 1 + REPEAT_SEQ).alias("seq"), (F.col("id") + 1).alias("id"), "name", F.lit("shifted").alias("description"))
    i = F.col("id")
    common = t.categories.filter(i % 3 == 0).select((i + 2 * REPEAT_SEQ).alias("seq"), "id", F.lit(" Common ").alias("name"), F.lit("common").alias("description"))
    return renames.unionByName(shifted).unionByName(common)


def category_delete_requests(t: Tables) -> DataFrame:
    once = t.categories_dirty.select(F.col("id").alias("seq"), "id")
    return once.unionByName(once.filter(F.col("id") % 2 == 1).select((F.col("seq") + REPEAT_SEQ).alias("seq"), "id"))


def inventory_insert_requests(t: Tables) -> DataFrame:
    p = t.raw("part")
    k = F.col("p_partkey")
    full = F.concat_ws(" ", "p_name", k.cast("string"))
    return p.select(
        k.alias("seq"),
        F.when(k % 29 == 0, F.concat(F.lit("New "), full)).otherwise(F.upper(full)).alias("name"),
        F.col("p_brand").alias("description"),
        F.lit(None).cast("bigint").alias("category_id"),
        F.concat(F.lit("NEW-"), k.cast("string")).alias("sku"),
        F.when(k % 31 == 0, F.lit(-1)).otherwise(k % 50).cast("int").alias("quantity"),
        F.lit(5).alias("min_quantity"),
        F.col("p_retailprice").cast(MONEY).alias("unit_price"),
        F.col("p_brand").alias("supplier"),
        F.lit(NEW_LOCATION).alias("location"),
    )


INVENTORY_NEW_COLS = {
    "new_name": T.StringType(),
    "new_description": T.StringType(),
    "new_category_id": T.LongType(),
    "new_sku": T.StringType(),
    "new_quantity": T.IntegerType(),
    "new_min_quantity": T.IntegerType(),
    "new_unit_price": MONEY,
    "new_supplier": T.StringType(),
    "new_location": T.StringType(),
}


def inventory_update_requests(t: Tables) -> DataFrame:
    p = t.raw("part").select("p_partkey", "p_name", "p_retailprice")
    prev = t.raw("part").select(F.col("p_partkey").alias("_pk"), F.col("p_name").alias("_pn"))
    k = F.col("p_partkey")
    j = p.join(prev, F.col("_pk") == k - 1, "left")
    prev_name = F.concat_ws(" ", "_pn", F.col("_pk").cast("string"))
    own = F.upper(F.concat_ws(" ", "p_name", k.cast("string")))
    df = j.select(
        k.alias("seq"),
        F.when(k % 29 == 0, -k).otherwise(k).alias("id"),  # no item has a negative id
        F.when(k % 4 == 0, _arr("quantity"))
        .when(k % 4 == 1, _arr("name"))
        .when(k % 4 == 2, _arr("unit_price", "supplier"))
        .otherwise(_arr())
        .alias("fields"),
        F.when(k % 8 == 1, own).otherwise(prev_name).alias("new_name"),
        (k % 50).cast("int").alias("new_quantity"),
        (F.col("p_retailprice").cast(MONEY) + 1).cast(MONEY).alias("new_unit_price"),
        F.lit(NEW_SUPPLIER).alias("new_supplier"),
    )
    more = p.filter(k % 3 == 0).select(
        (k + REPEAT_SEQ).alias("seq"),
        k.alias("id"),
        F.when(k % 2 == 0, _arr("quantity")).otherwise(_arr("supplier")).alias("fields"),
        F.lit(None).cast("string").alias("new_name"),
        F.lit(11).cast("int").alias("new_quantity"),
        F.lit(None).cast(MONEY).alias("new_unit_price"),
        F.lit(None).cast("string").alias("new_supplier"),
    )
    # two items ask for each of these names; some then ask for the name that another item gave up
    taken = p.filter(k % 6 == 0).select(
        (k + 2 * REPEAT_SEQ).alias("seq"), k.alias("id"), _arr("name").alias("fields"), F.concat(F.lit("Renamed "), F.floor(k / 12).cast("string")).alias("new_name")
    )
    given_up = p.filter(k % 6 == 0).select(
        (k + 3 * REPEAT_SEQ).alias("seq"), (k - 3).alias("id"), _arr("name", "supplier").alias("fields"),
        F.concat(F.lit(" "), F.lower(F.concat_ws(" ", "p_name", k.cast("string")))).alias("new_name"), F.lit(NEW_SUPPLIER).alias("new_supplier"),
    )
    return _nulls(df.unionByName(more).unionByName(taken, allowMissingColumns=True).unionByName(given_up, allowMissingColumns=True), INVENTORY_NEW_COLS)


def rows_delete_requests(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    once = t.raw("supplier").select(k.alias("seq"), k.alias("id"))
    return once.unionByName(once.filter(F.col("id") % 4 == 0).select((F.col("seq") + REPEAT_SEQ).alias("seq"), "id"))


SALES_NEW_COLS = {
    "new_quantity": T.IntegerType(),
    "new_unit_price": MONEY,
    "new_customer_name": T.StringType(),
    "new_customer_phone": T.StringType(),
    "new_staff_id": T.LongType(),
    "new_sale_date": T.TimestampNTZType(),
    "new_payment_method": T.StringType(),
    "new_notes": T.StringType(),
    "new_item_id": T.LongType(),
}


def sale_update_requests(t: Tables) -> DataFrame:
    s = t.sales
    i = F.col("id")
    df = s.select(
        i.alias("seq"),
        F.when(i % 31 == 5, -i).otherwise(i).alias("id"),  # no sale has a negative id
        F.when(i % 13 == 0, _arr())
        .when(i % 4 == 0, _arr("quantity"))
        .when(i % 4 == 1, _arr("unit_price"))
        .when(i % 4 == 2, _arr("customer_name"))
        .otherwise(_arr("quantity", "unit_price"))
        .alias("fields"),
        F.when(i % 44 == 0, F.lit(0)).when(i % 4 == 0, F.col("quantity") + 1).otherwise(F.lit(2)).cast("int").alias("new_quantity"),
        F.when(i % 4 == 1, F.lit(0)).otherwise(F.lit(9.99)).cast(MONEY).alias("new_unit_price"),
        F.lit("Walk-in").alias("new_customer_name"),
    )
    more = s.filter(i % 3 == 0).select(
        (i + REPEAT_SEQ).alias("seq"),
        i.alias("id"),
        F.when(i % 2 == 0, _arr("notes", "unit_price")).otherwise(_arr("quantity")).alias("fields"),
        F.lit(7).cast("int").alias("new_quantity"),
        F.when(i % 5 == 0, F.lit(0)).otherwise(F.lit(3.5)).cast(MONEY).alias("new_unit_price"),
        F.lit("x").alias("new_customer_name"),
    )
    return _nulls(df.unionByName(more), SALES_NEW_COLS)


def sale_delete_requests(t: Tables) -> DataFrame:
    once = t.sales.filter(F.col("notes") == "returned").select(F.col("id").alias("seq"), "id")
    i = F.col("id")
    return once.unionByName(once.filter(i % 5 == 0).select((i + REPEAT_SEQ).alias("seq"), "id")).unionByName(
        once.filter(i % 7 == 0).select((-i).alias("seq"), (-i).alias("id"))  # no sale has a negative id
    )


def staff_insert_requests(t: Tables) -> DataFrame:
    c = t.raw("customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("seq"),
        F.col("c_name").alias("name"),
        F.when(k % 50 == 1, F.lit("u1@example.com"))
        .when(k % 50 == 2, F.lit("bad-email"))
        .otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com")))
        .alias("email"),
        F.when(k % 40 == 3, F.lit("")).otherwise(F.lit(None).cast("string")).alias("phone"),
        F.lit("Clerk").alias("position"),
        F.col("c_mktsegment").alias("department"),
        F.when(k % 4 == 0, F.lit("2020-01-15"))
        .when(k % 4 == 1, F.lit("2021/03/04"))
        .when(k % 4 == 2, F.lit("03/04/2022"))
        .otherwise(F.lit("someday"))
        .alias("hire_date"),
        F.when(k % 45 == 7, F.lit("n/a")).otherwise(F.col("c_acctbal").cast(MONEY).cast("string")).alias("salary"),
    )


STAFF_NEW_COLS = {
    "new_name": T.StringType(),
    "new_email": T.StringType(),
    "new_phone": T.StringType(),
    "new_position": T.StringType(),
    "new_department": T.StringType(),
    "new_hire_date": T.DateType(),
    "new_salary": MONEY,
    "new_status": T.StringType(),
}


def staff_update_requests(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    df = t.raw("supplier").select(
        k.alias("seq"),
        F.when(k % 10 == 9, k + 100000).otherwise(k).alias("id"),
        F.when(k % 3 == 0, _arr("phone")).when(k % 3 == 1, _arr("salary")).otherwise(_arr("email", "department")).alias(
            "fields"
        ),
        F.concat(F.lit("555-"), k.cast("string")).alias("new_phone"),
        F.when(k % 7 == 1, F.lit(-1)).otherwise(k + 1000).cast(MONEY).alias("new_salary"),
        F.concat(F.lit("staff"), k.cast("string"), F.lit("@example.com")).alias("new_email"),
        F.lit("HQ").alias("new_department"),
    )
    more = t.raw("supplier").filter(k % 2 == 0).select(
        (k + REPEAT_SEQ).alias("seq"),
        k.alias("id"),
        F.when(k % 4 == 0, _arr("department")).otherwise(_arr("phone", "salary")).alias("fields"),
        F.lit(None).cast("string").alias("new_phone"),
        (k + 2000).cast(MONEY).alias("new_salary"),
        F.lit(None).cast("string").alias("new_email"),
        F.lit("Branch").alias("new_department"),
    )
    return _nulls(df.unionByName(more), STAFF_NEW_COLS)


# Requested statuses by supplier key % 4 ('retired' is invalid).
REQUESTED_STATUSES = ["active", "inactive", "terminated", "retired"]


def staff_status_requests(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    statuses = F.array(*[F.lit(s) for s in REQUESTED_STATUSES])
    return t.raw("supplier").select(
        k.alias("seq"), k.alias("id"), F.element_at(statuses, (k % 4 + 1).cast("int")).alias("status")
    )


# Month texts requested for months 1..5 of 2024.
BUDGET_REQUEST_MONTHS = ["2024-01", "2024/02", "Mar 2024", "202404", "2024-05-31"]


def budget_insert_requests(t: Tables) -> DataFrame:
    months = F.array(*[F.lit(m) for m in BUDGET_REQUEST_MONTHS])
    c = t.categories.select(F.col("id").alias("cid"), "name").withColumn(
        "m", F.explode(F.sequence(F.lit(1), F.lit(len(BUDGET_REQUEST_MONTHS))))
    )
    cid = F.col("cid")
    return c.select(
        (F.col("m") * 1000 + cid).alias("seq"),
        F.col("name").alias("category"),
        F.when(cid == 3, F.lit(-5)).otherwise(cid * 100).cast(MONEY).alias("amount"),
        F.lit(None).cast(MONEY).alias("spent"),
        F.element_at(months, F.col("m")).alias("month_year"),
    )


BUDGET_NEW_COLS = {
    "new_category": T.StringType(),
    "new_amount": MONEY,
    "new_spent": MONEY,
    "new_month_year": T.StringType(),
}


def budget_update_requests(t: Tables) -> DataFrame:
    b = t.budget
    i = F.col("id")
    df = b.select(
        i.alias("seq"),
        F.when(F.col("category") == "Pumps", i + 50000).otherwise(i).alias("id"),
        F.when(i % 3 == 0, _arr("amount")).when(i % 3 == 1, _arr("spent")).otherwise(_arr()).alias("fields"),
        (F.col("amount") + 500).cast(MONEY).alias("new_amount"),
        F.when(i % 2 == 0, F.lit(-1).cast(MONEY)).otherwise(F.col("spent") + 1).cast(MONEY).alias("new_spent"),
    )
    more = b.filter(i % 4 != 3).select(
        (i + REPEAT_SEQ).alias("seq"),
        i.alias("id"),
        F.when(i % 4 == 0, _arr("spent")).when(i % 4 == 1, _arr("amount")).otherwise(_arr("amount", "spent")).alias("fields"),
        (F.col("amount") + 700).cast(MONEY).alias("new_amount"),
        (F.col("spent") + 3).cast(MONEY).alias("new_spent"),
    )
    return _nulls(df.unionByName(more), BUDGET_NEW_COLS)


def staff_delete_requests(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    once = t.raw("supplier").filter(k % 3 == 0).select(k.alias("seq"), F.when(k % 4 == 0, -k).otherwise(k).alias("id"))
    return once.unionByName(once.filter(k % 5 == 0).select((F.col("seq") + REPEAT_SEQ).alias("seq"), "id"))


def budget_delete_requests(t: Tables) -> DataFrame:
    i = F.col("id")
    once = t.budget.filter(i % 2 == 0).select(i.alias("seq"), i)
    return once.unionByName(once.filter(i % 3 == 0).select((i + REPEAT_SEQ).alias("seq"), i))


def transaction_requests(t: Tables) -> DataFrame:
    i = F.col("seq")
    return t.transactions.withColumnRenamed("id", "seq").withColumns({
        "type": F.when(i % 17 == 0, F.lit("refund")).otherwise(F.col("type")),
        "amount": F.when(i % 19 == 0, F.lit(-1).cast(MONEY)).otherwise(F.col("amount")),
        "description": F.when(i % 23 == 0, F.lit(" ")).otherwise(F.col("description")),
    })


def inventory_of_duplicates(t: Tables) -> DataFrame:
    """Inventory of which even items point at a category's duplicate, where it has one."""
    c = F.col("category_id")
    return t.inventory.withColumn("category_id", F.when((F.col("id") % 2 == 0) & (c % 2 == 0), c + DUPLICATE_IDS).otherwise(c))


# Fixed value: the number of items that all requests of the busy fixture are for.
BUSY_ITEMS = 29


def busy_requests(t: Tables) -> DataFrame:
    return t.sale_requests.withColumn("item_id", F.abs("item_id") % BUSY_ITEMS)


def busy_inventory(t: Tables) -> DataFrame:
    """The busy items, with a half to a quarter of the stock that is asked for."""
    asked = busy_requests(t).groupBy(F.col("item_id").alias("id")).agg(F.sum("quantity").alias("asked"))
    return asked.join(t.inventory.drop("quantity"), "id", "left").withColumn(
        "quantity", F.floor(F.col("asked") / (2 + F.col("id") % 3)).cast("int")
    ).select(t.inventory.columns)


def migration_sources(t: Tables) -> dict[str, DataFrame]:
    """The tables as text, with rows that break each constraint of the target store."""
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    i = F.col("id")

    def with_rows(df: DataFrame, *planted: DataFrame) -> DataFrame:
        out = text(df)
        for p in planted:
            out = out.unionByName(text(p).select(*df.columns))
        return out

    c, s, v, b = t.categories, t.staff, t.inventory, t.budget
    categories = with_rows(
        c,
        c.filter(i % 4 == 0).withColumns({"id": i + 1000}),  # name taken
        c.filter(i % 4 == 0).withColumns({"id": i + 1000, "name": F.concat("name", F.lit(" II"))}),  # free: the row before lost
        c.filter(i % 4 == 0).withColumns({"id": i + 1001, "name": F.concat("name", F.lit(" II"))}),  # name taken now
        c.filter(i % 3 == 0).withColumns({"id": i + 2000, "name": F.lit(None).cast("string")}),
        c.filter(i % 5 == 0).withColumns({"id": i + 3000, "name": F.concat(F.repeat(F.lit("x"), F.lit(100)), i.cast("string"))}),
        c.filter(i % 6 == 0).withColumns({"id": F.concat(F.lit("no-"), i.cast("string"))}),
    )
    staff = with_rows(
        s,
        s.filter(i % 6 == 0).withColumns({"id": i + 100000}),  # email taken
        s.filter(i % 7 == 0).withColumns({"id": i + 200000, "email": F.lit(None).cast("string")}),
        s.filter(i % 8 == 0).withColumns({"id": i + 300000, "email": F.concat(F.lit("z"), "email"), "salary": F.lit("lots")}),
        s.filter(i % 9 == 0).withColumns({"id": i + 400000, "email": F.concat(F.lit("y"), "email"), "phone": F.repeat(F.lit("5"), F.lit(21))}),
    )
    inventory = with_rows(
        v.withColumn("category_id", F.when(i % 37 == 0, F.lit(-1)).when(i % 41 == 0, F.lit(1004)).otherwise(F.col("category_id"))),
        v.filter(i % 43 == 0).withColumns({"name": F.concat(F.lit("again "), "name")}),  # id taken, or taken later
        v.filter(i % 47 == 0).withColumns({"id": i + 10**9, "unit_price": F.lit("123456789.00")}),
    )
    budget = with_rows(
        b,
        b.filter(i % 5 == 0).withColumns({"id": i + 50000}),
        b.filter(i % 7 == 0).withColumns({"id": i + 60000, "month_year": F.lit("soon")}),
    )
    return {"categories": categories, "staff": staff, "inventory": inventory, "sales": text(t.sales), "budget": budget}


def raw_bodies(t: Tables, kind: str) -> DataFrame:
    """(seq, json): request bodies as they come, with wrong, empty, null and absent fields; every 53rd is no JSON."""
    table, key, tokens = RAW_BODIES[kind]
    source = t.raw(table) if table in ("part", "supplier") else getattr(t, table)
    cells = [F.concat(F.lit(f'"{f}":'), F.expr(token)) for f, token in tokens.items()]  # null (left out) where the token is
    body = F.concat(F.lit("{"), F.concat_ws(",", *cells), F.lit("}"))
    return source.select(F.col(key).alias("seq"), F.when(F.col(key) % 53 == 0, F.lit("{not json")).otherwise(body).alias("json"))


def sale_checks(t: Tables) -> DataFrame:
    """Sales of which some break a rule."""
    i = F.col("id")
    return t.sales.withColumns({
        "item_id": F.when(i % 29 == 0, F.lit(None).cast("bigint")).otherwise(F.col("item_id")),
        "quantity": F.when(i % 17 == 0, F.lit(0)).otherwise(F.col("quantity")),
        "unit_price": F.when(i % 23 == 0, F.lit(-1).cast(MONEY)).otherwise(F.col("unit_price")),
        "customer_name": F.when(i % 19 == 0, F.lit("  ")).otherwise(F.col("customer_name")),
    })


def remap_mapping(t: Tables) -> DataFrame:
    p = t.raw("part").filter(F.col("p_size") > 45)
    return p.select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("item_name"),
        F.when(F.col("p_size") % 2 == 0, F.lit("Pumps")).otherwise(F.lit("Valves")).alias("category_name"),
    )
