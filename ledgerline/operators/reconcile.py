"""Differences between two copies of data (problem 6).

EXCEPT ALL in both directions over normalised rows leaves only what differs. The residues name the keys
whose statements are then joined with all of the other side's, to tell one-sided rows from rows whose
fields differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import accession_key, amount, concept_key


def compare_copies(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], names: tuple[str, str]) -> DataFrame:
    """(keys..., difference): ``names`` for one-sided keys, else the names of fields that differ.

    Both sides need the columns ``keys + fields`` in comparable types; other columns are ignored.
    Repeated rows of a side count once. Null equals null in keys and fields, null differs from any
    value. A key may be stated in several ways: each statement of one side is compared with each of
    the other, with a row for every field in which a pair differs; statements of a key that the other
    side lacks give a row each.
    """
    cols = [*keys, *fields]
    a, b = (x.select(*cols).distinct() for x in (left, right))
    only_a, only_b = a.exceptAll(b), b.exceptAll(a)
    # several statements differ from one another even if both sides hold them all and leave no residue
    several = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    differing = only_a.select(*keys).union(only_b.select(*keys)).union(several.select(*keys)).distinct()
    pairs = a.join(_keyed(differing, keys), _meets(keys), "left_semi").join(_keyed(b, keys, F.struct(*fields).alias("__b")), _meets(keys), "left")
    one_sided = F.col("__b").isNull()
    diffs = [F.when(one_sided, F.lit(names[0])), *[F.when(~one_sided & ~F.col(f).eqNullSafe(F.col(f"__b.{f}")), F.lit(f)) for f in fields]]
    found = pairs.select(*keys, F.explode(F.array_compact(F.array(*diffs))).alias("difference"))
    return found.union(only_b.join(_keyed(a, keys), _meets(keys), "left_anti").select(*keys, F.lit(names[1])))


def _keyed(df: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    return df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *more)


def _meets(keys: list[str]) -> Column:
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return on


def crosscheck_sides(crosscheck: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two stacked copies as normalised (accession, concept_group, value, matched_concept) rows."""
    rows = crosscheck.select(
        F.lower(F.trim("side")).alias("side"), F.coalesce(accession_key(F.col("accession")), F.trim("accession")).alias("accession"), F.trim("concept_group").alias("concept_group"),
        F.col("our_value_usd").try_cast("decimal(38,10)").alias("ours"), amount(F.col("companyfacts_value")).alias("theirs"), F.nullif(concept_key(F.col("matched_concept")), F.lit("")).alias("matched_concept"),
    )
    pick = lambda side, v: rows.filter(F.col("side") == side).select("accession", "concept_group", F.col(v).alias("value"), "matched_concept")
    return pick("ours", "ours"), pick("companyfacts", "theirs")
