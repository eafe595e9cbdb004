from __future__ import annotations

from pyspark.sql import functions as F

from stockspark.functions import scalars as S


def test_parse_month_year_forms(spark):
    texts = ["2024-01", "2024/01", "202401", "2024-01-31", "Jan 2024", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    y, m = S.parse_month_year(F.col("t"))
    got = [(r.t, r.y, r.m) for r in df.select("t", y.alias("y"), m.alias("m")).collect()]
    assert got == [
        ("2024-01", 2024, 1),
        ("2024/01", 2024, 1),
        ("202401", 2024, 1),
        ("2024-01-31", 2024, 1),
        ("Jan 2024", None, None),
        (None, None, None),
    ]


def test_format_month_year_round_trip(spark):
    df = spark.createDataFrame([(2024, 3), (999, 12), (None, 1)], "y int, m int")
    got = [r[0] for r in df.select(S.format_month_year("y", "m")).collect()]
    assert got == ["2024-03", "0999-12", None]


def test_month_names(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    rows = df.select(S.month_name("m", "long").alias("l"), S.month_name("m", "short").alias("s")).collect()
    assert rows[0].l == "January" and rows[0].s == "Jan"
    assert rows[11].l == "December" and rows[11].s == "Dec"


def test_html_escape_and_blank(spark):
    df = spark.createDataFrame([("Pipes & <Fittings>",), ("   ",)], "n string")
    got = df.select(S.html_escape("n").alias("e"), S.blank_to_null("n").alias("b")).collect()
    assert got[0].e == "Pipes &amp; &lt;Fittings&gt;"
    assert got[1].b is None


def test_like_pattern_keeps_wildcards_and_escapes_backslash(spark):
    df = spark.createDataFrame([("SKU-12",), ("SKU-1",), ("a\\b",)], "s string")
    hits = [r.s for r in df.filter(F.col("s").ilike(S.like_pattern("sku-1_"))).collect()]
    assert hits == ["SKU-12"]
    hits = [r.s for r in df.filter(F.col("s").ilike(S.like_pattern("a\\b"))).collect()]
    assert hits == ["a\\b"]


def test_contains_ci_is_null_safe(spark):
    df = spark.createDataFrame([("Small Widget",), (None,)], "s string")
    got = [r[0] for r in df.select(S.contains_ci("s", "WIDGET")).collect()]
    assert got == [True, False]


def test_or_na_and_display(spark):
    df = spark.createDataFrame([("",), (None,), ("x",)], "s string")
    assert [r[0] for r in df.select(S.or_na("s")).collect()] == ["N/A", "N/A", "x"]
    m = spark.createDataFrame([("12.5",)], "v string").select(F.col("v").cast("decimal(10,2)").alias("v"))
    assert m.select(S.display_money("v")).first()[0] == "KSH 12.50"
