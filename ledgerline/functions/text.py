"""Column expressions that bring unevenly written keys, dates and numbers to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accession_key(c: Column) -> Column:
    """Dashed 10-2-6 form of an accession however it is punctuated; null if it has not 18 digits."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    dashed = F.concat_ws("-", F.substring(digits, 1, 10), F.substring(digits, 11, 2), F.substring(digits, 13, 6))
    return F.when(F.length(digits) == 18, dashed)


def accession_number(c: Column) -> Column:
    """The 18 digits of a dashed accession as a number; null for any other spelling."""
    return F.when(c.rlike(r"^\d{10}-\d{2}-\d{6}$"), F.replace(c, F.lit("-"), F.lit("")).cast("bigint"))


def accession_text(c: Column) -> Column:
    """The dashed accession of an ``accession_number``."""
    digits = F.lpad(c.cast("string"), 18, "0")
    return F.concat(F.substring(digits, 1, 10), F.lit("-"), F.substring(digits, 11, 2), F.lit("-"), F.substring(digits, 13, 6))


def local_name(c: Column) -> Column:
    """Concept without its namespace prefix (up to the first colon) and outer blanks."""
    return F.trim(F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", -1)).otherwise(c))


def concept_key(c: Column) -> Column:
    """Concept name without ``prefix:`` or ``prefix_``, blanks and case."""
    return F.lower(F.regexp_replace(F.trim(c), r"^[A-Za-z0-9-]+[:_]", ""))


def iso_day(c: Column) -> Column:
    """Date at the start of an unevenly written ISO date or timestamp; null where there is none."""
    day = F.regexp_extract(F.trim(c), r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1)
    return F.expr("try_cast(null as date)") if c is None else F.nullif(day, F.lit("")).try_cast("date")


def amount(c: Column) -> Column:
    """Exact DECIMAL(38,10) of a printed number: separators, exponent, sign or parentheses."""
    t = F.regexp_replace(F.trim(c), r"[,\s$]", "")
    inner = F.regexp_extract(t, r"^\((.*)\)$", 1)
    value = F.when(inner != "", F.concat(F.lit("-"), inner)).otherwise(t)
    return F.nullif(value, F.lit("")).try_cast("decimal(38,10)")


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)
