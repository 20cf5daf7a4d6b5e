"""Evaluation operators: intervals, percentiles, verdicts, audits, differences and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Audited sections with the lengths in characters between which they are plausible.
SECTIONS = {"item_1_business": (1_000, 250_000), "item_1a_risk_factors": (1_000, 250_000), "item_1c_cyber": (1_000, 250_000), "item_3_legal": (1_000, 250_000), "item_7_mda": (1_000, 250_000), "item_7a_market_risk": (1_000, 250_000), "fs_notes": (10_000, 600_000), "fs_income_stmt": (1_500, 60_000), "fs_balance_sheet": (1_500, 60_000), "fs_cash_flow": (1_500, 60_000), "fs_equity": (1_500, 60_000)}


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """(low, high) of the score interval of a proportion, within [0, 1]; (0, 0) for no trials."""
    p = F.try_divide(k.cast("double"), n)
    mid = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    den = 1 + z * z / n
    low, high = F.greatest(F.lit(0.0), (mid - half) / den), F.least(F.lit(1.0), (mid + half) / den)
    return F.struct(F.when(n == 0, 0.0).otherwise(low).alias("low"), F.when(n == 0, 0.0).otherwise(high).alias("high"))


def summarize(scored: DataFrame, category: str, passed: Column) -> DataFrame:
    """(category, n, passed, rate, low, high) per category and, under a null category, overall."""
    g = scored.withColumn("__p", passed).rollup(category).agg(F.count(F.lit(1)).alias("n"), F.count_if("__p").alias("passed"))
    ci = wilson(F.col("passed"), F.col("n"))
    return g.select(category, "n", "passed", F.round(F.try_divide(F.col("passed"), F.col("n")), 6).alias("rate"), F.round(ci.getField("low"), 6).alias("low"), F.round(ci.getField("high"), 6).alias("high"))


def nearest_rank(df: DataFrame, group: list[str], value: str, fraction: float, name: str) -> DataFrame:
    """Element at index round-half-even(fraction x (n - 1)) of each group's sorted values; nulls are left out.

    A value's position needs no sorted group: distinct values are counted first and their counts summed.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*group)
    placed = counts.withColumn("__to", F.sum("__c").over(w.orderBy(value))).withColumn("__n", F.sum("__c").over(w))
    index = F.bround(F.lit(fraction) * (F.col("__n") - 1)) + 1
    return placed.filter((F.col("__to") >= index) & (F.col("__to") - F.col("__c") < index)).select(*group, F.col(value).alias(name))


def floor_rank(df: DataFrame, group: list[str], value: str, fraction: float, name: str) -> DataFrame:
    """Element at index min(n - 1, whole part of n x fraction) of each group's sorted values; nulls are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*group)
    placed = counts.withColumn("__to", F.sum("__c").over(w.orderBy(value))).withColumn("__n", F.sum("__c").over(w))
    index = F.least(F.col("__n") - 1, F.floor(F.col("__n") * fraction)) + 1
    return placed.filter((F.col("__to") >= index) & (F.col("__to") - F.col("__c") < index)).select(*group, F.col(value).alias(name))


def role_totals(calls: DataFrame, run: str, role: str, tokens: Column) -> DataFrame:
    """(run, role, calls, tokens, share): calls and tokens of each role, and its share of the run's tokens."""
    g = calls.groupBy(run, F.col(role).alias("role")).agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens"))
    return g.withColumn("share", F.round(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy(run))), 6))


def metric_means(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """(group, columns..., n): means of given quality columns; nulls are left out of a mean."""
    return rows.groupBy(group).agg(*[F.round(F.avg(c), 6).alias(c) for c in columns], F.count(F.lit(1)).alias("n"))


def classify_difference(ours: Column, theirs: Column, decimals: Column | None = None) -> Column:
    """exact, sign_error, scale_error, rounding (within a whole unit), oracle_precision or mismatch.

    A scale error is an exact power of ten, tested by multiplication.
    """
    scale = F.lit(False)
    a, b = F.abs(ours), F.abs(theirs)
    for p in range(1, 13):
        power = F.lit(10**p).cast(f"decimal({p + 1},0)")
        scale = scale | (a == b * power) | (b == a * power)
    out = F.when(F.abs(ours - theirs) <= F.abs(theirs) * F.lit(0.05).cast("decimal(3,2)"), F.when(b < F.lit(0.001).cast("decimal(4,3)"), "oracle_precision").otherwise("mismatch")).otherwise("mismatch")
    if decimals is not None:
        unit = F.concat(F.lit("1E"), (-decimals.try_cast("int")).cast("string")).try_cast("decimal(38,10)")
        out = F.when(F.coalesce(F.abs(ours - theirs) <= unit, F.lit(False)), "rounding").otherwise(out)
    out = F.when((ours != 0) & (theirs != 0) & scale, "scale_error").otherwise(out)
    return F.when(ours == theirs, "exact").when((ours == -theirs) & (ours != 0), "sign_error").otherwise(out)


def section_audit(lengths: DataFrame, key: list[str]) -> DataFrame:
    """(key..., section_id, chars, verdict) of every audited section of every key: ok, too_small, too_large, empty, missing.

    ``lengths`` holds key, section_id and chars; the fixed list of sections is joined to each key.
    """
    spark = lengths.sparkSession
    spec = spark.createDataFrame([(s, lo, hi) for s, (lo, hi) in SECTIONS.items()], "section_id string, lo int, hi int")
    wanted = lengths.select(*key).distinct().withColumn("section_id", F.explode(F.array(*[F.lit(s) for s in SECTIONS])))
    joined = wanted.join(lengths, [*key, "section_id"], "left").join(F.broadcast(spec), "section_id")
    verdict = F.when(F.col("chars").isNull(), "missing").when(F.col("chars") == 0, "empty").when(F.col("chars") < F.col("lo"), "too_small").when(F.col("chars") > F.col("hi"), "too_large").otherwise("ok")
    return joined.select(*key, "section_id", "chars", verdict.alias("verdict"))


def absorbed(passages: DataFrame, key: list[str], section: str, text: str, ident: str, headings: dict[str, str]) -> DataFrame:
    """(key..., section_id, documents, first_doc): sections that a key lacks but whose heading pattern another passage of it holds.

    Each passage is tested where it is read and only the names of matching sections travel. Null texts hold none.
    """
    tests = F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(s)) for s, p in headings.items()]))
    spoken = passages.select(*key, F.col(ident).alias("__d"), F.explode(tests).alias("section_id")).groupBy(*key, "section_id").agg(F.count(F.lit(1)).alias("documents"), F.min("__d").alias("first_doc"))
    has = passages.select(*key, F.col(section).alias("section_id")).distinct()
    return spoken.join(has, [*key, "section_id"], "left_anti")


def compare_audits(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., before, after, change): gained, lost, shifted or same by a full outer join."""
    a = before.select(*key, F.col(value).alias("before"))
    b = after.select(*key, F.col(value).alias("after"))
    change = F.when(F.col("before").isNull(), "gained").when(F.col("after").isNull(), "lost").when(F.col("before") == F.col("after"), "same").otherwise("shifted")
    return a.join(b, key, "full_outer").withColumn("change", change)


def distractors(figures: DataFrame, entity: str, period: str, metric: str, value: str) -> DataFrame:
    """(entity, period, metric, kind, n, least, greatest): other periods of the entity and other entities of the period.

    Both kinds are summarised by their own key instead of being paired: the totals of a key less the
    row's own contribution are what the pairs would hold. Least and greatest are over the other rows.
    """
    def side(key: list[str], kind: str) -> DataFrame:
        w = Window.partitionBy(*key, metric)
        v = F.col(value)
        order = w.orderBy(v, entity, period)
        lo1, lo2 = F.first_value(v).over(order), F.nth_value(v, 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        down = w.orderBy(v.desc(), entity, period)
        hi1, hi2 = F.first_value(v).over(down), F.nth_value(v, 2).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        rank, rank_down = F.row_number().over(order), F.row_number().over(down)
        return figures.select(entity, period, metric, F.lit(kind).alias("kind"), (F.count(F.lit(1)).over(w) - 1).alias("n"), F.when(rank == 1, lo2).otherwise(lo1).alias("least"), F.when(rank_down == 1, hi2).otherwise(hi1).alias("greatest")).filter("n > 0")

    return side([entity], "wrong_period").unionByName(side([period], "wrong_entity"))


def all_required(items: DataFrame, ident: str, required: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """(ident, covered): whether every requirement of an item is at hand; items without any are covered.

    A null in the last key of a requirement stands for any value.
    """
    full = have.select(*keys).distinct().withColumn("__hit", F.lit(True))
    loose = have.select(*keys[:-1]).distinct().withColumn("__any", F.lit(True))
    j = required.join(full, keys, "left").join(loose, keys[:-1], "left")
    met = F.when(F.col(keys[-1]).isNull(), F.col("__any")).otherwise(F.col("__hit"))
    per = j.groupBy(ident).agg(F.bool_and(F.coalesce(met, F.lit(False))).alias("covered"))
    return items.select(ident).distinct().join(per, ident, "left").select(ident, F.coalesce("covered", F.lit(True)).alias("covered"))


def stratified(df: DataFrame, strata: list[str], ident: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows taken round-robin from the strata, within a stratum in seeded hash order.

    No stratum gives more than ``n`` rows, so each task passes on only its own first ``n`` of a stratum.
    """
    order = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(ident).cast("string")))
    ranked = df.withColumn("round", F.row_number().over(Window.partitionBy(*strata).orderBy(order, ident)))
    return ranked.filter(F.col("round") <= n).orderBy("round", *strata).limit(n)


def round_robin(df: DataFrame, topic: str, spread: str, ident: str, n: int) -> DataFrame:
    """Rows spread over ``spread`` within each topic, then taken in turns from the topics, each topic's first ``spread`` rotated by its rank.

    The filer with which a topic begins moves on by one from topic to topic, so that not every topic
    begins with the same. No topic gives more than ``n`` rows, so tasks pass on only their first.
    """
    first = df.withColumn("__a", F.row_number().over(Window.partitionBy(topic, spread).orderBy(ident))).filter(F.col("__a") <= n)
    names = F.dense_rank().over(Window.partitionBy(topic).orderBy(spread))
    topics = df.select(topic).distinct().withColumn("__t", F.row_number().over(Window.orderBy(topic)) - 1)  # one row a topic
    sizes = df.select(topic, spread).distinct().groupBy(topic).agg(F.count(F.lit(1)).alias("__m"))
    turned = first.withColumn("__s", names - 1).join(F.broadcast(topics), topic).join(F.broadcast(sizes), topic).withColumn("__s", F.pmod(F.col("__s") - F.col("__t"), F.col("__m")))
    turn = turned.withColumn("turn", F.row_number().over(Window.partitionBy(topic).orderBy("__a", "__s", ident))).filter(F.col("turn") <= n).drop("__a", "__s", "__t", "__m")
    return turn.orderBy("turn", topic).limit(n)


#: Citations of a turn, as they stand in its JSON.
CITATIONS = "array<struct<index: bigint, accession: string, filing_date: string>>"


def citation_flags(citations: Column, refused: Column, as_of: Column) -> Column:
    """Sorted flags of an array of citation structs (index, accession, filing_date)."""
    n = F.coalesce(F.size(citations), F.lit(0))
    some = n > 0
    indices = F.transform(citations, lambda c: c.getField("index"))
    numbered = indices == F.sequence(F.lit(1).cast("bigint"), n.cast("bigint"))
    blank = F.exists(citations, lambda c: (F.coalesce(c.getField("accession"), F.lit("")) == "") | (F.coalesce(c.getField("filing_date"), F.lit("")) == ""))
    ahead = F.exists(citations, lambda c: F.coalesce(c.getField("filing_date") > as_of, F.lit(False)))
    invalid = some & (~F.coalesce(numbered, F.lit(False)) | F.coalesce(blank, F.lit(False)) | refused)
    return F.array_compact(F.array(F.when(invalid, "citation_invalid"), F.when(some & ahead, "look_ahead")))
