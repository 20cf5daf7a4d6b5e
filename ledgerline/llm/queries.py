"""Queries of the problems 2, 4, 7, 8 and 9 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import listed_filings
from ..operators.statements import statements
from ..runtime import cut, table
from . import leaks, packing, pairs, sql, survivors, unify


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.duplicate_facts(table(spark, d, "facts"))


def p2_latest(spark: SparkSession, d: str) -> DataFrame:
    """Latest text value of each filer's attributes, its rows' own dates unused: order learned from all filers' dated rows."""
    rows = statements(table(spark, d, "facts")).filter("value_text is not null").select("accession", "concept", "value_text")
    listed = listed_filings(table(spark, d, "filings")).select("accession", "cik", "filing_date")
    dated = rows.join(listed, "accession").filter("cik is not null")
    order = survivors.learn_precedence(dated, ["cik"], "concept", "value_text", "filing_date")
    return survivors.latest_values(dated, ["cik"], "concept", "value_text", order)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "turns")
    listed = pairs.question_response_pairs(turns, table(spark, d, "responses"))
    return pairs.broken_pairs(listed, turns.select("question", F.col("answer").alias("response")))


def p4_defects(spark: SparkSession, d: str) -> DataFrame:
    """Number of defective pairs by source and defect."""
    return p4_found(spark, d).groupBy("source", "defect").agg(F.count(F.lit(1)).alias("pairs"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in containers of every budget."""
    sized = cut(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"))
    return packing.pack(sized, table(spark, d, "budgets")).withColumnRenamed("ident", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packed(spark, d), table(spark, d, "budgets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "gold_items"), "item_id", ["question", "passage"]).select("doc_id", "item_id")


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a 12-word window of an item of which at most two words are altered."""
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "gold_items"), "item_id", ["question", "passage"], altered=2)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = unify.lookalikes(table(spark, d, "documents"), "doc_id", "text")
    return found.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the class of texts that look like its own."""
    return unify.look_classes(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("ident", "doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_latest, p4_found, p4_defects, p7_packed, p7_fill, p8_found, p8_near, p9_found, p9_classes)}


def oracle_sql() -> dict[str, str]:
    return dict(sql.SQL)
