"""Spark session settings used by the library, the tests and the benchmark.

The library never creates a session behind the caller's back: operators take
DataFrames.  ``build_session`` is for local runs (tests, bench); on a cluster
the job's own session is passed in and ``tune_session`` only sets what is
still unset.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime SQL settings every job relies on.  ANSI mode stays on (Spark 4
# default): overflow and bad casts raise instead of silently producing NULL,
# so operators use try_* functions where NULL is the wanted result.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def tune_session(spark: SparkSession) -> SparkSession:
    """Apply RUNTIME_CONF where nothing is set and make sure a checkpoint directory is known.

    What the caller has set stays as it is, the time zone too: all times of the
    library are zone-less, and the daily stream uses a session of its own.

    The checkpoint directory is read from ``spark.checkpoint.dir``; a
    temporary local one is set only when nothing is configured (local runs).
    """
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one.  Otherwise a local
    master (tests) gets a scratch folder; any other master is refused, since its
    executors would not see the driver's folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="stockspark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    spark.sparkContext.setCheckpointDir(local)
    return local


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside are removed as soon as it is written.

    Spark keeps them until the driver happens to collect its garbage, which a
    large driver may not do for hours.  Only for frames that are not run again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "stockspark",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local session for tests and the benchmark (UI off, AQE on, UTC)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune_session(spark)
