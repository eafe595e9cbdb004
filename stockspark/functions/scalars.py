"""Column functions shared by the operators (all built-in, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MONEY_SUM, VALUE_SUM

# Fixed value: the currency prefix shown next to amounts.
CURRENCY_PREFIX = "KSH "


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- aggregates with engine-independent result types ---------
def money_sum(c) -> Column:
    """SUM of a DECIMAL(10,2) column as DECIMAL(20,2)."""
    return F.sum(col(c)).cast(MONEY_SUM)


def value_sum(qty, price) -> Column:
    """SUM(quantity * price) as DECIMAL(24,2)."""
    return F.sum(col(qty) * col(price)).cast(VALUE_SUM)


def int_sum(c) -> Column:
    return F.sum(col(c)).cast("bigint")


def mean(c) -> Column:
    """AVG as CAST(SUM AS DOUBLE) / COUNT, NULL when there is no value."""
    return F.sum(col(c)).cast("double") / F.nullif(F.count(col(c)), F.lit(0))


def safe_ratio_pct(num, den) -> Column:
    """num / den * 100 in DOUBLE; NULL when den is 0 or NULL."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0)) * 100


# -- dates (G3-G7) -----------------------------------------------------------
def day(c) -> Column:
    return F.to_date(col(c))


def year_text(c) -> Column:
    return F.date_format(col(c), "yyyy")


def month_text(c) -> Column:
    return F.date_format(col(c), "MM")


def month_year(c) -> Column:
    """'YYYY-MM' of a date or timestamp."""
    return F.date_format(col(c), "yyyy-MM")


def month_name(month_number, style: str = "long") -> Column:
    """Month number 1-12 -> 'January' (long) or 'Jan' (short)."""
    pattern = "MMMM" if style == "long" else "MMM"
    return F.date_format(F.make_date(F.lit(2000), col(month_number), F.lit(1)), pattern)


# -- budget month parsing (G1, G2) -------------------------------------------
# Fixed pattern: four-digit year, optional '-' or '/', two-digit month, at the
# start of the text ('YYYYMM' and 'YYYY-MM-DD' also match).
MONTH_YEAR_PATTERN = r"^(\d{4})[-/]?(\d{2})"


def parse_month_year(c) -> tuple[Column, Column]:
    """(year, month) as INT, both NULL when the text does not match."""
    text = col(c).cast("string")
    y = F.nullif(F.regexp_extract(text, MONTH_YEAR_PATTERN, 1), F.lit(""))
    m = F.nullif(F.regexp_extract(text, MONTH_YEAR_PATTERN, 2), F.lit(""))
    ok = y.isNotNull() & m.isNotNull()
    return (
        F.when(ok, y.cast("int")),
        F.when(ok, m.cast("int")),
    )


def format_month_year(year, month) -> Column:
    """(year, month) -> 'YYYY-MM'; NULL when either part is missing."""
    return F.when(
        col(year).isNotNull() & col(month).isNotNull(),
        F.format_string("%04d-%02d", col(year), col(month)),
    )


# -- text (G8-G11, G15, G17) -------------------------------------------------
def norm_name(c) -> Column:
    """The duplicate-detection key: LOWER(TRIM(name))."""
    return F.lower(F.trim(col(c)))


def like_pattern(term: str) -> str:
    """'%term%' for ILIKE; '%' and '_' stay wildcards, backslash is literal."""
    return "%" + term.replace("\\", "\\\\") + "%"


def contains_ci(c, term: str) -> Column:
    """Case-insensitive substring test, NULL-safe (NULL -> false)."""
    return F.coalesce(F.contains(F.lower(col(c)), F.lower(F.lit(term))), F.lit(False))


def or_na(c) -> Column:
    """`x || 'N/A'`: NULL and '' both become 'N/A'."""
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit("N/A"))


def display_money(c) -> Column:
    """'KSH 12.50' (two decimals); NULL stays NULL."""
    return F.concat(F.lit(CURRENCY_PREFIX), F.format_string("%.2f", col(c).cast("double")))


# HTML escaping applied to category names on input.
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;"), ("\\", "&#x5C;"), ("`", "&#96;")]


def html_escape(c) -> Column:
    out = col(c)
    for raw, escaped in HTML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def blank_to_null(c) -> Column:
    """Trimmed text, or NULL when empty (`description?.trim() || null`)."""
    return F.nullif(F.trim(col(c)), F.lit(""))
