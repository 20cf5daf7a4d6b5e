"""Readable and exact renderings of figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calc import plain

# Thresholds and names of the scales, largest first.
SCALES = ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"))
CENTS = "decimal(38,2)"


def grouped(v: Column) -> Column:
    """Integer digits grouped by thousands, decimals kept: of the absolute value."""
    s = plain(F.abs(v))
    whole, rest = F.substring_index(s, ".", 1), F.when(F.instr(s, ".") > 0, F.concat(F.lit("."), F.substring_index(s, ".", -1))).otherwise("")
    return F.concat(F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", ","), rest)


def exact(v: Column, unit: Column) -> Column:
    money = F.coalesce(F.upper(unit).startswith("USD"), F.lit(False))
    return F.concat(F.when(v < 0, "-").otherwise(""), F.when(money, "$").otherwise(""), grouped(v))


def money(v: Column, unit: Column) -> Column:
    """``$391.04 billion``, promoted to the next scale where rounding reaches a thousand; rates per share; else exact."""
    m = F.abs(v).cast("decimal(38,10)")
    cents = lambda c: F.round(c, 2).cast(CENTS).cast("string")
    sign = F.when(v < 0, "-").otherwise("")
    out = F.when(m >= 1000, F.concat(sign, F.lit("$"), grouped(F.bround(m, 0)))).otherwise(F.concat(sign, F.lit("$"), cents(m)))
    for i in range(len(SCALES) - 1, -1, -1):
        step, name = SCALES[i]
        scaled = F.round(m / F.lit(step).cast("decimal(14,0)"), 2)
        shown = F.concat(sign, F.lit("$"), cents(scaled), F.lit(f" {name}"))
        if i:
            up, upper = SCALES[i - 1]
            shown = F.when(scaled >= 1000, F.concat(sign, F.lit("$"), cents(F.round(m / F.lit(up).cast("decimal(14,0)"), 2)), F.lit(f" {upper}"))).otherwise(shown)
        out = F.when(m >= step, shown).otherwise(out)
    rate = F.concat(F.lit("$"), F.round(v.cast("decimal(38,10)"), 2).cast(CENTS).cast("string"), F.lit(" per share"))
    currency = F.coalesce(F.upper(unit).startswith("USD") & ~F.contains(unit, F.lit("/")), F.lit(False))
    return F.when(F.contains(unit, F.lit("/")), rate).when(currency, out).otherwise(exact(v, unit))


def percent(v: Column) -> Column:
    return F.concat(F.round(v.cast("decimal(38,10)"), 2).cast(CENTS).cast("string"), F.lit("%"))


def times(v: Column) -> Column:
    return F.concat(F.round(v.cast("decimal(38,10)"), 2).cast(CENTS).cast("string"), F.lit("x"))


def value(v: Column, unit: Column) -> Column:
    return F.when(unit == "percent", percent(v)).when(unit == "ratio", times(v)).when(unit.isNull() | unit.isin("shares", "pure", ""), exact(v, unit)).otherwise(money(v, unit))


def with_exact(v: Column, unit: Column) -> Column:
    """Readable form followed by the exact figure, unless that is the same."""
    readable, full = value(v, unit), exact(v, unit)
    return F.when(F.contains(readable, full), readable).otherwise(F.concat(readable, F.lit(" ("), full, F.lit(")")))


def available(labels: Column) -> Column:
    """``2022 to 2025`` for contiguous years, else a list."""
    s = F.array_sort(F.array_distinct(labels))
    first, last = F.element_at(s, 1), F.element_at(s, -1)
    whole = (last - first + 1) == F.size(s)
    return F.when(F.size(s) == 0, F.lit("")).when(whole & (F.size(s) > 1), F.concat(first.cast("string"), F.lit(" to "), last.cast("string"))).otherwise(F.array_join(F.transform(s, lambda x: x.cast("string")), ", "))


def archive_path(cik: Column, accession: Column, document: Column) -> Column:
    """Public archive path of a document: accession without dashes as folder."""
    return F.concat(F.lit("/Archives/edgar/data/"), cik.cast("string"), F.lit("/"), F.regexp_replace(accession, "-", ""), F.lit("/"), document)


def rendered_numerals(v: Column, scales: tuple[int, ...] = (0, 3, 6, 9)) -> Column:
    """Ways a figure may be printed: at each scale where it is whole and has two digits or more, grouped and ungrouped."""
    forms = []
    for s in scales:
        q = F.abs(v).cast("decimal(38,10)") / F.lit(10**s).cast("decimal(10,0)")
        ok = (q == F.floor(q)) & (q >= 10)
        forms += [F.when(ok, grouped(q)), F.when(ok, plain(q))]
    return F.array_distinct(F.array_compact(F.array(*forms)))
