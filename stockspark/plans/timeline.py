"""Names that change hands within one batch, settled in rounds.

Requests (seq, id, key) ask, in ``seq`` order, to give row ``id`` the name ``key``.  A request is
refused when another row has that name at that moment; otherwise it takes the name and frees the
one that the row had.  What a request finds thus depends on earlier requests for the same name
and on those of the rows that have it, but not on its own row's name.

A round looks at the first undecided request for every name:

* a row that has the name, and asks for no other before some moment, has it until then: every
  request of other rows for the name up to that moment is refused at once;
* when no other row has it, and none that had it may still have it (its next request is
  undecided), the first request takes the name, with all that the same row makes before another
  row asks; a row that has the name alone may ask for it again while it has it.

The earliest undecided request of all can always be decided, so rounds end; their number is the
longest chain of rows that take a name from one another, not the number of requests.  All steps
are aggregates and joins on the name or the id with one row per key on one side; the successor of
a request is found by ranges, so an id or a name with a third of all requests is spread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .ordering import next_change

#: Order of names held before the first request, and of no end.
START, FOREVER = -(1 << 63), (1 << 63) - 1


def settle_names(holders: DataFrame, wants: DataFrame) -> DataFrame:
    """The accepted ones of ``wants`` (seq unique, id, key), given who has which name before (id, key)."""
    spark = wants.sparkSession
    root = f"{checkpoint_dir(spark).rstrip('/')}/stockspark/names-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    cells = [F.col("seq").cast("bigint").alias("seq"), F.col("id").cast("bigint").alias("id"), "key"]
    waiting = kept(wants.select(*cells), "wants")
    before = holders.select(F.lit(START).alias("seq"), F.col("id").cast("bigint").alias("id"), "key")
    taken = kept(before.join(wants.select("key").distinct(), "key", "left_semi").select("seq", "id", "key"), "taken-0")
    accepted = []
    while not waiting.isEmpty():
        turn = len(accepted)
        events = waiting.withColumn("undecided", F.lit(True)).unionByName(taken.withColumn("undecided", F.lit(False)))
        # asking again for the name it has does not end a row's hold
        chain = next_change(events, "id", "seq", "key", ["seq", "undecided"], "then")
        first = waiting.groupBy("key").agg(F.min(F.struct("seq", "id")).alias("w"))
        held = chain.where(~F.col("undecided")).join(first, "key").where(F.col("seq") < F.col("w.seq")).select(
            "key",
            "id",
            F.when(F.col("then").isNull(), F.lit(FOREVER)).when(F.col("then.seq") > F.col("w.seq"), F.col("then.seq")).alias("until"),
            ((F.col("then.seq") < F.col("w.seq")) & F.col("then.undecided")).alias("unsure"),
        )
        state = held.groupBy("key").agg(
            F.max(F.when(F.col("until").isNotNull(), F.struct("until", "id"))).alias("top"),
            F.min(F.when(F.col("unsure"), F.col("id"))).alias("low"),
            F.max(F.when(F.col("unsure"), F.col("id"))).alias("high"),
        )
        second = held.join(state.select("key", "top"), "key").where(F.col("id") != F.col("top.id")).groupBy("key").agg(F.max("until").alias("second"))
        others = waiting.join(first, "key").where(F.col("id") != F.col("w.id")).groupBy("key").agg(F.min("seq").alias("other"))
        names = first.join(state, "key", "left").join(second, "key", "left").join(others, "key", "left")
        mine = F.col("id") == F.col("top.id")
        # nobody but the row itself may have the name
        alone = F.coalesce((F.col("low") == F.col("id")) & (F.col("high") == F.col("id")), F.lit(True)) & F.col("second").isNull()
        while_held = (
            F.when(~mine & (F.col("seq") < F.col("top.until")), False)
            .when(mine & (F.col("seq") < F.col("second")), False)
            .when(mine & (F.col("seq") < F.col("top.until")) & alone, True)
        )
        while_free = F.when((F.col("id") == F.col("w.id")) & (F.col("seq") < F.coalesce("other", F.lit(FOREVER))) & alone, True)
        ok = F.when(F.col("top").isNotNull(), while_held).otherwise(while_free).alias("ok")
        judged = kept(waiting.join(names, "key").select("seq", "id", "key", ok), f"judged-{turn}")
        accepted.append(judged.where("ok").drop("ok"))
        taken = taken.unionByName(accepted[-1])
        waiting = judged.where("ok is null").drop("ok")
    out = wants.select(*cells).limit(0)
    for part in accepted:
        out = out.unionByName(part)
    return out
