"""Queries of the general training-data problems (1, 3, 5, 6) over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, history, reconcile, wide
from ..runtime import table

#: Columns of the wide table shown by p3_wide.
SHOWN = [("Assets", "number"), ("Liabilities", "number"), ("Revenues", "number"), ("NetIncomeLoss", "number"), ("EntityRegistrantName", "text"), ("AmendmentFlag", "boolean"), ("DocumentPeriodEndDate", "date")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return asof.filing_in_force(table(spark, d, "outcomes"), table(spark, d, "filings"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.filled_cells(table(spark, d, "facts"))


def p3_wide(spark: SparkSession, d: str) -> DataFrame:
    shown = wide.wide_table(wide.fact_cells(table(spark, d, "facts")), ["accession", "end_date"], "concept", SHOWN)
    return shown.withColumns({c: F.col(c).cast("double") for c, k in SHOWN if k == "number"})


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """The whole wide table: every concept of every filing and date in its own typed column."""
    return wide.whole_table(wide.fact_cells(table(spark, d, "facts")), ["accession", "end_date"], "concept")


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    return wide.attribute_types(wide.fact_cells(table(spark, d, "facts")), "concept")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.restated_numbers(table(spark, d, "facts"), table(spark, d, "filings"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    ours, theirs = reconcile.crosscheck_sides(table(spark, d, "ixbrl_crosscheck"))
    return reconcile.compare_copies(ours, theirs, ["accession", "concept_group"], ["value", "matched_concept"], ("only_ours", "only_companyfacts"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_wide, p3_table, p3_columns, p5_found, p6_found)}
