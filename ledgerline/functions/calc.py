"""Guarded arithmetic on resolved figures as column expressions.

Every function returns a struct (value, error): the first guard that fails names the error and leaves
the value null. Operands are exact decimals of at most 18 digits before the point (greater ones are
``out_of_range``); quotients are rounded half up once, from whole numbers, and only roots are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT, PERIOD, ZERO, NEGATIVE, RANGE, FEW = "unit_mismatch", "period_mismatch", "zero_base", "negative_base", "out_of_range", "too_few_operands"
#: Operands and results.
EXACT, RESULT = "decimal(28,10)", "decimal(38,10)"


def _number(v: Column) -> Column:
    return v.try_cast(EXACT)


def _guarded(value: Column, operands: list[Column], *guards: tuple[Column, str]) -> Column:
    error = F.lit(None).cast("string")
    for v in operands:
        error = F.when(v.isNotNull() & _number(v).isNull(), F.lit(RANGE)).otherwise(error)
    for failed, name in reversed(guards):
        error = F.when(F.coalesce(failed, F.lit(True)), F.lit(name)).otherwise(error)
    return F.struct(F.when(error.isNull(), value.cast(RESULT)).alias("value"), error.alias("error"))


def quotient(a: Column, b: Column, places: int) -> Column:
    """a / b to ``places`` decimals, half up, computed in whole numbers; null for a zero divisor."""
    n, d = F.abs(_number(a)), F.abs(_number(b))
    twice = (n * F.lit(2 * 10**places).cast("decimal(8,0)")).cast(RESULT) + d.cast(RESULT)
    whole = F.call_function("div", twice.cast(RESULT), F.nullif((d * F.lit(2).cast("decimal(1,0)")).cast(RESULT), F.lit(0).cast(RESULT)))
    return (F.signum(_number(a)).cast("decimal(1,0)") * F.signum(_number(b)).cast("decimal(1,0)") * whole.cast("decimal(20,0)") * F.lit("0." + "0" * (places - 1) + "1").cast(f"decimal({places},{places})")).cast(RESULT)


def _apart(a: dict[str, Column], b: dict[str, Column]) -> list[tuple[Column, str]]:
    return [(~a["unit"].eqNullSafe(b["unit"]), UNIT), (~a["period_type"].eqNullSafe(b["period_type"]), PERIOD), (a["end"] == b["end"], PERIOD)]


def growth_pct(later: dict[str, Column], earlier: dict[str, Column]) -> Column:
    """(a - b) / b x 100 to two places; same unit and period type, different ends, positive base."""
    a, b = later["value"], earlier["value"]
    change = (_number(a) - _number(b)).cast(EXACT)
    return _guarded(quotient(change, b, 4) * 100, [a, b], *_apart(later, earlier), (b == 0, ZERO), (b < 0, NEGATIVE))


def cagr_pct(later: dict[str, Column], earlier: dict[str, Column], years: Column) -> Column:
    """((a / b) ^ (1 / years) - 1) x 100 to two places; a root is a double, and so is its rounding."""
    a, b = later["value"].cast("double"), earlier["value"].cast("double")
    ok = (b > 0) & (a >= 0) & (years > 0)
    rate = F.when(ok, (F.pow(F.try_divide(a, b), F.try_divide(F.lit(1.0), years)) - 1) * 100)
    return _guarded(F.round(rate, 2), [], *_apart(later, earlier), (b == 0, ZERO), (b < 0, NEGATIVE), (years <= 0, PERIOD), (a < 0, NEGATIVE))


def margin_pct(num: dict[str, Column], den: dict[str, Column]) -> Column:
    """a / b x 100 to two places; same unit and the same end."""
    a, b = num["value"], den["value"]
    return _guarded(quotient(a, b, 4) * 100, [a, b], (~num["unit"].eqNullSafe(den["unit"]), UNIT), (num["end"] != den["end"], PERIOD), (b == 0, ZERO))


def ratio(num: dict[str, Column], den: dict[str, Column]) -> Column:
    """a / b to four places, whatever the units."""
    return _guarded(quotient(num["value"], den["value"], 4), [num["value"], den["value"]], (den["value"] == 0, ZERO))


def difference(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """a - b, exactly; same unit and period type."""
    return _guarded((_number(a["value"]) - _number(b["value"])).cast(RESULT), [a["value"], b["value"]], (~a["unit"].eqNullSafe(b["unit"]), UNIT), (~a["period_type"].eqNullSafe(b["period_type"]), PERIOD))


def total(values: Column, units: Column) -> Column:
    """Aggregate: exact sum of a group's values if all carry one unit (a missing unit is a unit of its own)."""
    unit = F.coalesce(units, F.lit(""))
    return F.struct(F.when((F.count(values) > 0) & (F.min(unit) == F.max(unit)), F.try_sum(_number(values)).cast(RESULT)).alias("value"), F.when(F.count(values) == 0, FEW).when(F.min(unit) != F.max(unit), UNIT).alias("error"))


def dispatch(computation: Column, later: dict[str, Column], earlier: dict[str, Column], denominator: dict[str, Column], years: Column, summed: Column) -> Column:
    """The calculation that a question asks for, as a struct (operation, value, error).

    Margin, ratio and difference take two metrics where there is a denominator, else ratio and difference
    two periods; growth is what any other question gets, a margin without a denominator included. ``summed``
    is the struct of ``total``. Without an earlier period there is nothing to compare (``too_few_operands``).
    """
    two = denominator["value"].isNotNull()
    pair = earlier["value"].isNotNull() & later["value"].isNotNull()
    done = lambda name, s: F.struct(F.lit(name).alias("operation"), s.getField("value").alias("value"), s.getField("error").alias("error"))
    none = F.struct(F.lit(None).cast("string").alias("operation"), F.lit(None).cast(RESULT).alias("value"), F.lit(FEW).alias("error"))
    return (
        F.when((computation == "margin_pct") & two, done("margin_pct", margin_pct(later, denominator))).when((computation == "ratio") & two, done("ratio", ratio(later, denominator))).when((computation == "difference") & two, done("difference", difference(later, denominator)))
        .when(~pair, none).when((computation == "cagr_pct") & (years >= 1), done("cagr_pct", cagr_pct(later, earlier, years))).when(computation == "cagr_pct", none).when(computation == "difference", done("difference", difference(later, earlier)))
        .when(computation == "sum", done("sum", summed)).when(computation == "ratio", done("ratio", ratio(later, earlier))).otherwise(done("growth_pct", growth_pct(later, earlier)))
    )


def formula(kind: str, a: Column, b: Column) -> Column:
    """The calculation in fixed notation."""
    shown = {"growth_pct": "({a} - {b}) / {b} x 100", "margin_pct": "{a} / {b} x 100", "ratio": "{a} / {b}", "difference": "{a} - {b}"}[kind]
    parts: list[Column] = []
    for piece in shown.replace("{a}", "\x00a\x00").replace("{b}", "\x00b\x00").split("\x00"):
        if piece:
            parts.append(plain(a) if piece == "a" else plain(b) if piece == "b" else F.lit(piece))
    return F.concat(*parts)


def plain(v: Column) -> Column:
    """A decimal without exponent and trailing zeros."""
    s = v.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
