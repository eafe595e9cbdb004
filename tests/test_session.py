from __future__ import annotations

import contextlib
import io

from stockspark.session import checkpoint_dir, tune_session
from stockspark.sources.fixtures import literal_rows


def test_tune_session_keeps_configured_checkpoint_dir(spark):
    before = checkpoint_dir(spark)
    tune_session(spark)
    assert checkpoint_dir(spark) == before
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"


def test_literal_rows_plan_as_local_relation(spark):
    df = literal_rows(spark, [(1, "a"), (2, "b")], "id bigint, name string")
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    assert "ExistingRDD" not in buf.getvalue()
    assert sorted(tuple(r) for r in df.collect()) == [(1, "a"), (2, "b")]


def test_tune_session_keeps_what_the_caller_set(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "America/New_York")
    tune_session(own)
    assert own.conf.get("spark.sql.session.timeZone") == "America/New_York"
    assert own.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
