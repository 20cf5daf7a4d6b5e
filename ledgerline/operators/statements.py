"""Statements of quantities: the raw facts that count, and half of what a declared precision leaves open."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.precision import EXACT, digits
from ..functions.text import blank_to_null, local_name

#: What ``precision.half_unit`` gives for places that a DECIMAL(38,10) cannot hold.
_WIDEST = Decimal("9" * 28)


def statements(facts: DataFrame) -> DataFrame:
    """Non-nil facts with the columns that decide duplicates; rows without id, accession or concept are left out."""
    return facts.select(
        "id", F.trim("accession").alias("accession"), "unit", "start_date", "end_date", local_name(F.col("concept")).alias("concept"), "value", "value_text", digits(F.col("decimals")).alias("rank"),
        *[blank_to_null(F.col(c)).alias(c) for c in ("context_id", "source_doc", "element_id") if c in facts.columns],
    ).filter("(value is not null or value_text is not null) and id is not null and accession is not null and concept is not null")


def half(rank: int | None) -> Decimal | None:
    """The same as ``precision.half_unit``, of one rank."""
    if rank is None:
        return None
    if rank >= min(10, EXACT):
        return Decimal(0)
    return _WIDEST if rank < -26 else Decimal(5).scaleb(-(rank + 1))
