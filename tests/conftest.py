from __future__ import annotations

import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from stockspark.session import tune_session

    s = (
        SparkSession.builder.master("local[*]")
        .appName("stockspark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    tune_session(s)
    yield s
    s.stop()


def D(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def TS(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@pytest.fixture
def frames(spark):
    """Builders of tiny literal tables with the business schemas."""
    from stockspark import schemas as sch

    def make(schema, rows):
        names = [f.name for f in schema.fields]
        full = [tuple(r.get(n) for n in names) for r in rows]
        return spark.createDataFrame(full, schema)

    class F:
        categories = staticmethod(lambda rows: make(sch.CATEGORIES, rows))
        inventory = staticmethod(lambda rows: make(sch.INVENTORY, rows))
        sales = staticmethod(lambda rows: make(sch.SALES, rows))
        staff = staticmethod(lambda rows: make(sch.STAFF, rows))
        budget = staticmethod(lambda rows: make(sch.BUDGET, rows))
        transactions = staticmethod(lambda rows: make(sch.TRANSACTIONS, rows))

    return F
