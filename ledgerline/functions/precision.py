"""Declared precision of a number: digits after the point, INF for exact, null for undeclared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank of an exact number; larger than any digit count.
EXACT = 10000
MONEY = "decimal(38,10)"


def digits(decimals: Column) -> Column:
    """INT precision rank of a raw ``decimals`` attribute; null if blank or not a number."""
    d = F.upper(F.trim(decimals))
    return F.when(d == "INF", F.lit(EXACT)).otherwise(F.nullif(d, F.lit("")).try_cast("int"))


def half_unit(rank: Column) -> Column:
    """Half a unit of the declared last place as an exact decimal; 0 from ten digits on."""
    text = F.concat(F.lit("5E"), (-(rank + 1)).cast("string"))
    cap = F.lit("9" * 28).cast(MONEY)
    return F.when(rank.isNull(), F.lit(None).cast(MONEY)).when(rank >= 10, F.lit(0).cast(MONEY)).when(rank < -26, cap).otherwise(text.try_cast(MONEY))


def explained(a: Column, a_half: Column, b: Column, b_half: Column) -> Column:
    """True if two numbers differ by no more than the sum of both half units; undeclared explains nothing."""
    return F.coalesce(F.abs(a - b) <= a_half + b_half, F.lit(False))
