"""Fact store operators: queries, own-period filter, precision preference, hashes and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.precision import digits, explained, half_unit
from ..functions.text import local_name
from .upkeep import fingerprint

# Days around a period end and lengths of a year that count as the filing's own period.
TOLERANCE_DAYS = 3
YEAR_DAYS = (350, 380)
ENTITY_CONCEPTS = ("AmendmentFlag", "DocumentFiscalYearFocus", "DocumentPeriodEndDate", "DocumentType", "EntityCentralIndexKey", "EntityFilerCategory", "EntityRegistrantName")


def query(facts: DataFrame, ticker: str | None = None, concepts: list[str] | None = None, accessions: list[str] | None = None, end_date: str | None = None, period_type: str | None = None) -> DataFrame:
    """Conjunction of the given conditions, ordered by ticker, concept, end date, accession and id."""
    df = facts
    if ticker is not None:
        df = df.filter(F.col("ticker") == ticker.upper())
    if concepts is not None:
        df = df.filter(F.col("concept").isin(concepts))
    if accessions is not None:
        df = df.filter(F.col("accession").isin(accessions))
    if end_date is not None:
        df = df.filter(F.col("end_date") == F.lit(end_date).cast("date"))
    if period_type is not None:
        df = df.filter(F.col("period_type") == period_type)
    return df.orderBy("ticker", "concept", "end_date", "accession", "id")


def with_facts(filings: DataFrame, facts: DataFrame) -> DataFrame:
    return filings.join(facts.select("accession"), "accession", "left_semi")


def numeric(facts: DataFrame) -> DataFrame:
    """Non-nil numeric facts of the consolidated entity (``dimensions`` empty, where there is such a column)."""
    kept = facts.filter("value is not null")
    return kept.filter(F.size("dimensions") == 0) if "dimensions" in facts.columns else kept


def annual(facts: DataFrame, filings: DataFrame, tolerance: int = TOLERANCE_DAYS) -> DataFrame:
    """Numeric facts of each filing's own period: instants near its end, durations of about a year that end near it."""
    ends = filings.select("accession", "period_end").groupBy("accession").agg(F.max("period_end").alias("period_end"))
    near = F.abs(F.datediff("end_date", "period_end")) <= tolerance
    length = F.datediff("end_date", "start_date")
    own = F.when(F.col("period_type") == "instant", near).otherwise(near & length.between(*YEAR_DAYS))
    return numeric(facts).join(ends, "accession").filter(own)


def prefer_precise(facts: DataFrame) -> DataFrame:
    """Per (accession, concept, context, unit) the most precise instance and those it does not explain.

    Order: declared precision first, more digits first, then element, document and value. Nulls in the
    key are a value of their own.
    """
    ranked = facts.withColumn("__rank", digits(F.col("decimals"))).withColumn("__half", half_unit(F.col("__rank")))
    w = Window.partitionBy("accession", "concept", "context_id", "unit").orderBy(F.col("__rank").desc_nulls_last(), "element_id", "source_doc", "value", "id")
    first = {c: F.first_value(c).over(w) for c in ("id", "value", "__half")}
    same = (F.col("value") == first["value"]) | explained(F.col("value"), F.col("__half"), first["value"], first["__half"])
    return ranked.withColumn("__keep", (F.col("id") == first["id"]) | ~same).filter("__keep").drop("__rank", "__half", "__keep")


def stats(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("concept").alias("concepts"), F.count_distinct("accession").alias("submissions"), F.count_distinct("ticker").alias("tickers"))


def content_hash(facts: DataFrame, fields: list[str]) -> DataFrame:
    """(accession, facts, hash): SHA-256 per filing over its rows in any order, see ``fingerprint``; null is the empty string."""
    row = F.concat_ws("\u001f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    return fingerprint(facts, ["accession"], row).withColumnRenamed("rows", "facts")


def needs_build(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(accession, state): built, unchanged or new by comparison of two hash tables."""
    j = current.select("accession", F.col("hash").alias("h")).join(stored.select("accession", F.col("hash").alias("was")), "accession", "left")
    return j.select("accession", F.when(F.col("was").isNull(), "new").when(F.col("was") == F.col("h"), "unchanged").otherwise("built").alias("state"))


def ambiguous_concepts(facts: DataFrame, concepts: list[str]) -> DataFrame:
    """Filings that state several different values under alternative ``concepts`` of one metric."""
    own = facts.filter(F.col("value").isNotNull()).withColumn("concept", local_name(F.col("concept"))).filter(F.col("concept").isin(concepts))
    g = own.groupBy("accession").agg(F.count_distinct("concept").alias("concepts"), F.count_distinct("value").alias("distinct_values"), F.array_join(F.sort_array(F.collect_set("concept")), ",").alias("names"))
    return g.withColumn("ambiguous", (F.col("concepts") > 1) & (F.col("distinct_values") > 1))


def entity_map(facts: DataFrame) -> DataFrame:
    """First entity fact of each kind per filing, by least id, as columns: its text, or the whole part of its number.

    Facts with dimensions, where there is such a column, don't speak of the entity and are left out.
    """
    own = facts.filter(F.size("dimensions") == 0) if "dimensions" in facts.columns else facts
    said = F.coalesce("value_text", F.col("value").cast("bigint").cast("string"))
    named = own.withColumn("concept", local_name(F.col("concept"))).withColumn("said", said).filter(F.col("concept").isin(*ENTITY_CONCEPTS) & F.col("said").isNotNull())
    return named.groupBy("accession").agg(*[F.min(F.when(F.col("concept") == c, F.struct("id", "said"))).getField("said").alias(c) for c in ENTITY_CONCEPTS])


def scale_survey(facts: DataFrame) -> DataFrame:
    """Counts by scale, sign and kind of fact."""
    kind = F.when(F.col("value").isNotNull(), "numeric").when(F.col("value_text").isNotNull(), "text").otherwise("nil")
    return facts.groupBy("scale_raw", "sign_raw", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
