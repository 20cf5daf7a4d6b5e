"""Attributes as known at event time (problem 1).

Each event gets a version number: the count of changes of its entity up to the event's day, taken
over narrow (entity, day) rows. Wide attributes are then fetched by an equi-join on entity and number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import accession_key, iso_day
from ..runtime import cut


def as_known(
    events: DataFrame,
    changes: DataFrame,
    entity: list[str],
    event_day: str,
    change_day: str,
    prefer: list[Column],
    split: str | None = None,
) -> DataFrame:
    """Inner-join every event with the attributes of its entity in force on the event's day.

    Of several changes of one entity and day the greatest by ``prefer`` counts, of equal ones that of the
    greatest 64-bit row hash, by which rows of an entity are told apart. The result has the
    columns of ``events`` and a struct ``known`` holding the whole change row, so clashing names are
    harmless. Events or changes with a null entity column or day never match; events before the first
    change are left out; repeated events stay repeated; empty inputs give an empty result.

    Changes and events are pre-aggregated to distinct (entity, day) pairs before any window, so a
    window holds at most two rows a calendar day however hot the entity is. ``split`` ("month",
    "year") additionally counts within that period first and adds the totals of earlier periods.
    """
    e, day = entity, "__day"
    usable = F.lit(True)
    for c in entity:
        usable = usable & F.col(c).isNotNull()
    keys = [f"__k{i}" for i in range(len(e))]
    keyed = changes.filter(usable & F.col(change_day).isNotNull()).select(
        *[F.col(c).alias(k) for c, k in zip(e, keys)], F.col(change_day).cast("date").alias(day), F.xxhash64(*changes.columns).alias("__id"),
        F.struct(*[p.alias(f"p{i}") for i, p in enumerate(prefer)]).alias("__p"), F.struct(*[F.col(c) for c in changes.columns]).alias("known"),
    )
    # the winner of a day is picked by its preference and row hash; the row itself is joined to the answers at the end
    best = keyed.groupBy(*keys, day).agg(F.max(F.struct("__p", "__id")).alias("__best")).select(*keys, day, F.col("__best.__id").alias("__id"))
    asked = events.filter(usable & F.col(event_day).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(e, keys)], F.col(event_day).cast("date").alias(day)).distinct()
    marks = best.select(*keys, day, F.lit(1).alias("__c"), F.lit(0).alias("__e")).unionByName(asked.select(*keys, day, F.lit(0).alias("__c"), F.lit(1).alias("__e")))
    narrow = marks.groupBy(*keys, day).agg(F.max("__c").alias("__c"), F.max("__e").alias("__e"))
    if split is None:
        numbered = narrow.withColumn("__v", F.sum("__c").over(Window.partitionBy(*keys).orderBy(day)))
    else:
        narrow = narrow.withColumn("__p", F.trunc(day, split))
        totals = narrow.groupBy(*keys, "__p").agg(F.sum("__c").alias("__t"))
        before = totals.select(*keys, "__p", F.coalesce(F.sum("__t").over(Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
        inside = F.sum("__c").over(Window.partitionBy(*keys, "__p").orderBy(day))
        numbered = narrow.withColumn("__i", inside).join(before, [*keys, "__p"]).withColumn("__v", F.col("__i") + F.col("__b"))
    numbered = numbered.select(*keys, day, "__c", "__e", "__v")
    versions = numbered.filter("__c = 1").join(best, [*keys, day]).select(*keys, "__v", "__id")
    named = numbered.filter("__e = 1 and __v > 0").select(*keys, day, "__v").join(versions, [*keys, "__v"]).select(*keys, day, "__id")
    wide = keyed.select(*keys, "__id", "known").dropDuplicates([*keys, "__id"])
    answered = named.join(wide, [*keys, "__id"]).select(*keys, day, "known")
    left = events.withColumn(day, F.col(event_day).cast("date"))
    for c, k in zip(e, keys):
        left = left.withColumn(k, F.col(c))
    return left.join(answered, [*keys, day]).select(*[F.col(c) for c in events.columns], "known")


def listed_filings(filings: DataFrame) -> DataFrame:
    """One row per accession of a possibly repeated listing: the columns that decide what is in force.

    Rows without an accession are left out; of contradictory listings the least date, cik and label count.
    """
    return (
        filings.select(accession_key(F.col("accession")).alias("accession"), "cik", "fiscal_label", "filing_date", F.upper(F.trim("form_type")).alias("form_type"), accession_key(F.col("amends")).alias("amends"))
        .filter("accession is not null")
        .groupBy("accession")
        .agg(F.min("cik").alias("cik"), F.min("fiscal_label").alias("fiscal_label"), F.min("filing_date").alias("filing_date"), F.max("form_type").alias("form_type"), F.max("amends").alias("amends"))
    )


def amendment_roots(listed: DataFrame) -> DataFrame:
    """(accession, root, depth) of each filing that amends a listed one, by pointer doubling.

    A round doubles the length of the chains followed, so chains of any length end after a logarithmic
    number of rounds. Filings in or behind a cycle have no root and are left out.
    """
    known = listed.select(F.col("accession").alias("root"))
    step = listed.filter("amends is not null and amends <> accession").select("accession", F.col("amends").alias("root"), F.lit(1).alias("depth"))
    state = cut(step.join(known, "root", "left_semi").select("accession", "root", "depth"))
    rounds = max(1, math.ceil(math.log2(state.count() + 1)) + 1)
    ahead = lambda s: s.select(F.col("accession").alias("root"), F.col("root").alias("__r"), F.col("depth").alias("__d"))
    for _ in range(rounds):
        if not state.join(ahead(state), "root", "left_semi").take(1):
            return state
        state = cut(state.join(ahead(state), "root", "left").select("accession", F.coalesce("__r", "root").alias("root"), (F.col("depth") + F.coalesce("__d", F.lit(0))).alias("depth")))
    return state.join(ahead(state).select("root"), "root", "left_anti").select("accession", "root", "depth")


def filings_by_year(filings: DataFrame) -> DataFrame:
    """Listed filings with ``year`` (the fiscal year they count for), ``amendment`` and ``depth``."""
    listed = cut(listed_filings(filings))
    roots = amendment_roots(listed)
    labels = listed.select(F.col("accession").alias("root"), F.col("fiscal_label").alias("__label"))
    return (
        listed.join(roots, "accession", "left")
        .join(labels, "root", "left")
        .select("accession", "cik", "filing_date", "fiscal_label", F.coalesce("__label", "fiscal_label").alias("year"), F.when((F.col("form_type") == "10-K/A") | F.col("root").isNotNull(), 1).otherwise(0).alias("amendment"), F.coalesce("depth", F.lit(0)).alias("depth"))
    )


def filing_in_force(outcomes: DataFrame, filings: DataFrame) -> DataFrame:
    """(outcome_id, accession): the filing in force for the outcome's cik and year on its ``as_of`` day.

    Outcomes without a day in ``as_of``, without cik or year, or before the first filing are left out.
    Repeated outcomes count once; of contradictory repetitions the least (day, cik, year) counts.
    """
    asked = (
        outcomes.select("outcome_id", iso_day(F.col("as_of")).alias("day"), "cik", F.col("fiscal_label").alias("year"))
        .filter("outcome_id is not null and day is not null and cik is not null and year is not null")
        .groupBy("outcome_id")
        .agg(F.min(F.struct("day", "cik", "year")).alias("a"))
        .select("outcome_id", "a.day", "a.cik", "a.year")
    )
    prefer = [F.col("amendment"), F.col("depth"), F.col("accession")]
    changes = filings_by_year(filings).select("cik", "year", "filing_date", "amendment", "depth", "accession")
    return as_known(asked, changes, ["cik", "year"], "day", "filing_date", prefer).select("outcome_id", F.col("known.accession").alias("accession"))
