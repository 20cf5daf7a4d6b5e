"""Transforms of tagged texts: dates, booleans and ballot boxes. What can't be transformed keeps its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the formats by what they read.
MONTH_NAME = ("date-monthname-day-year-en", "datemonthnamedayyearen", "datemonthdayyearen")
MONTH_DAY_YEAR = ("date-month-day-year", "datemonthdayyear")
YEAR_MONTH = ("date-year-month", "dateyearmonth")
TRUE, FALSE, BALLOT = ("fixed-true", "fixedtrue", "booleantrue"), ("fixed-false", "fixedfalse", "booleanfalse"), ("boolballotbox",)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
KNOWN = MONTH_NAME + MONTH_DAY_YEAR + YEAR_MONTH + TRUE + FALSE + BALLOT


def _month(name: Column) -> Column:
    """Number of a month by its whole English name or its first three letters."""
    full = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
    pairs = {**dict(zip(full, range(1, 13))), **dict(zip(MONTHS, range(1, 13)))}
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), F.lower(F.regexp_replace(name, "[.,]", "")))


def tagged_text(fmt: Column, text: Column) -> Column:
    """Struct (value, failed) of a tagged text.

    Month names with day and year, numeric dates (two-digit years belong to this century), year and month,
    fixed booleans and ballot boxes are read; a text of another format, or that its format can't read, is
    kept as it is, the latter with ``failed``. An empty text is null.
    """
    name = F.lower(F.regexp_replace(F.coalesce(fmt, F.lit("")), r"^.*:", ""))
    raw = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s\u00a0\u2007\u2009\u202f]+", " "), r"[^\x00-\x7f\p{L}\p{N}]", "")
    words = F.filter(F.split(F.trim(spaced), r"[\s,]+"), lambda w: w != "")
    nums = F.filter(F.split(raw, r"[^0-9]+"), lambda w: w != "")
    pad = lambda c, n: F.lpad(c.try_cast("int").cast("string"), n, "0")
    w = lambda i: F.get(words, F.lit(i))
    n = lambda i: F.get(nums, F.lit(i))
    named = F.when((F.size(words) >= 3) & _month(w(0)).isNotNull() & w(1).try_cast("int").isNotNull() & w(2).try_cast("int").isNotNull(), F.concat_ws("-", pad(w(2), 4), pad(_month(w(0)).cast("string"), 2), pad(w(1), 2)))
    year = F.when(n(2).try_cast("int") < 100, (n(2).try_cast("int") + 2000).cast("string")).otherwise(n(2))
    mdy = F.when(F.size(nums) >= 3, F.concat_ws("-", pad(year, 4), pad(n(0), 2), pad(n(1), 2)))
    ym = F.when(F.size(nums) >= 2, F.concat_ws("-", pad(n(0), 4), pad(n(1), 2)))
    ballot = F.when(raw.rlike("[☑☒xX]"), "true").otherwise("false")
    made = F.when(name.isin(*MONTH_NAME), named).when(name.isin(*MONTH_DAY_YEAR), mdy).when(name.isin(*YEAR_MONTH), ym).when(name.isin(*TRUE), "true").when(name.isin(*FALSE), "false").when(name.isin(*BALLOT), ballot)
    kept = F.nullif(raw, F.lit(""))
    return F.struct(F.when(name.isin(*KNOWN), F.coalesce(made, kept)).otherwise(kept).alias("value"), (name.isin(*KNOWN) & made.isNull()).alias("failed"))
