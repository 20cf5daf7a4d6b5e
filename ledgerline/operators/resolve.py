"""Point-in-time resolution of one exact figure per (ticker, metric, period), or a named reason.

Every filing is resolved once for every metric, whoever asks: its facts meet the candidate concepts where
they are read, the first tier with facts decides. Requests are reduced to distinct (period key, day) pairs
and meet the states of their key in one sorted pass, so neither a ticker with many filings nor a day asked for
often is ever paired row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fmt
from ..functions.text import local_name
from ..runtime import broadcast_if_small, cut
from . import registry

#: Day that stands for "no bound".
ALWAYS = "9999-12-31"
#: Numerals that a text must hold to count as a statement.
LEAST_NUMERALS = 20
#: Metrics by their position in the figures of a filing.
METRICS = tuple(registry.METRICS)


def _forced(metric: Column, ticker: Column, label: Column) -> Column:
    """Concept that an override prescribes for a metric, ticker and fiscal label; the first applicable one counts."""
    out = F.lit(None).cast("string")
    for m, t, first, last, concept in reversed(registry.OVERRIDES):
        applies = (metric == m) & (ticker == t)
        applies = applies & (label >= first) if first is not None else applies
        applies = applies & (label <= last) if last is not None else applies
        out = F.when(F.coalesce(applies, F.lit(False)), F.lit(concept)).otherwise(out)
    return out


def resolve_filings(filings: DataFrame, store: DataFrame) -> DataFrame:
    """(accession, metric, reason, hit): every metric of which a filing states a candidate.

    ``hit`` has value, unit, concept, rule and scale_raw, or is null with ``reason`` ``ambiguous_concept``.
    An override that applies replaces all tiers. ``filings`` hold one row per accession; null values
    and unlisted filings are left out.
    """
    spark = filings.sparkSession
    cand = registry.candidates(spark)
    forced = registry.overrides(spark).join(cand.select("metric", "period_type").distinct(), "metric").select("metric", "period_type", F.lit("").alias("sector"), F.lit(1).alias("tier"), "concept")
    wanted = F.broadcast(cand.unionByName(forced).distinct())  # the registry: a fixed list
    own = F.broadcast(registry.sectors(spark).join(cand.select("metric", "sector").distinct(), "sector").select("ticker", "metric", F.col("sector").alias("own")))
    facts = store.filter("value is not null").select("accession", local_name(F.col("concept")).alias("concept"), "value", "unit", "period_type", "scale_raw")
    met = facts.join(wanted, ["concept", "period_type"]).join(filings.select("accession", "ticker", "fiscal_label"), "accession").join(own, ["ticker", "metric"], "left")
    met = met.withColumn("forced", _forced(F.col("metric"), F.col("ticker"), F.col("fiscal_label")))
    met = met.filter(F.when(F.col("forced").isNotNull(), (F.col("sector") == "") & (F.col("concept") == F.col("forced"))).otherwise(F.col("sector") == F.coalesce("own", F.lit("default"))))
    tiers = met.groupBy("accession", "metric", "tier").agg(
        (F.min("value") == F.max("value")).alias("one"), (F.min("concept") == F.max("concept")).alias("single"), F.min(F.struct("concept", "value", "unit", "scale_raw")).alias("pick"), F.bool_or(F.col("forced").isNotNull()).alias("forced")
    )
    first = tiers.groupBy("accession", "metric").agg(F.min(F.struct("tier", "one", "single", "pick", "forced")).alias("t"))
    later = F.when(F.col("t.tier") > 1, F.concat(F.lit("_tier"), F.col("t.tier").cast("string"))).otherwise("")
    rule = F.when(F.col("t.forced"), "override").otherwise(F.concat(F.when(F.col("t.single"), "single_candidate").otherwise("candidates_agree"), later))
    hit = F.struct(F.col("t.pick.value").alias("value"), F.col("t.pick.unit").alias("unit"), F.col("t.pick.concept").alias("concept"), rule.alias("rule"), F.col("t.pick.scale_raw").alias("scale_raw"))
    return first.select("accession", "metric", F.when(~F.col("t.one"), "ambiguous_concept").alias("reason"), F.when(F.col("t.one"), hit).alias("hit"))


def settled_filings(filings: DataFrame, store: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """One row per listed accession: ticker, f_end, fiscal_label, filing_date, form_type, amended, covered, bits and figures.

    ``figures`` hold for every metric of ``METRICS`` a struct of ``reason`` and ``hit`` (null where the filing states
    no candidate), ``bits`` the positions that have a hit; ``hit`` has ``validation_status`` if ``statements`` are given
    (see ``validate``). The rows are written once, so what follows doesn't plan the facts again.
    """
    listed = filings.groupBy("accession").agg(
        F.max(F.upper("ticker")).alias("ticker"), F.max("period_end").alias("f_end"), F.max("fiscal_label").alias("fiscal_label"), F.max("filing_date").alias("filing_date"), F.max("form_type").alias("form_type"), F.max(F.upper("form_type")).like("%/A").alias("amended")
    )
    outcomes = resolve_filings(listed, store)
    if statements is not None:
        outcomes = cut(outcomes)
        own = outcomes.filter("hit is not null").select("accession", "metric", F.lit("resolved").alias("status"), "hit.value", "hit.scale_raw").join(listed.select("accession", "ticker", "fiscal_label"), "accession")
        judged = validate(own, statements).select("accession", "metric", "validation_status")
        outcomes = outcomes.join(judged, ["accession", "metric"], "left").withColumn("hit", F.when(F.col("hit").isNotNull(), F.col("hit").withField("validation_status", F.col("validation_status"))))
    slots = outcomes.groupBy("accession").agg(*[F.first(F.when(F.col("metric") == m, F.struct("reason", "hit")), ignorenulls=True).alias(f"__{i}") for i, m in enumerate(METRICS)])
    held = [F.when(F.col(f"__{i}.hit").isNotNull(), F.lit(1 << i)).otherwise(0) for i in range(len(METRICS))]
    figures = slots.select("accession", reduce(lambda x, y: x + y, held).alias("bits"), F.array(*[f"__{i}" for i in range(len(METRICS))]).alias("figures"))
    stored = store.filter("value is not null").select("accession").distinct().withColumn("covered", F.lit(True))
    return cut(listed.join(stored, "accession", "left").join(figures, "accession", "left"))


def _timeline(settled: DataFrame) -> DataFrame:
    """(key, day, accession, state) of every key by which a period may be asked for: what holds from the day on.

    A state tells of the newest period filed so far its ``reason`` (if no figure can be had), ``amendment`` (the newest one)
    and ``parts``: the filings that settle its metrics with the positions they settle as bits. A metric is settled by the
    newest filing with a figure, else by the oldest. Every key has a state of its own for the time before its first filing.
    """
    keys = F.array(
        F.concat_ws("|", "ticker", F.lit("fiscal_label"), F.col("fiscal_label").cast("string")), F.concat_ws("|", "ticker", F.lit("calendar_year"), F.year("f_end").cast("string")),
        F.concat_ws("|", "ticker", F.lit("period_end"), F.col("f_end").cast("string")), F.concat_ws("|", "ticker", F.lit("latest"), F.lit("")),
    )
    keyed = settled.filter("ticker is not null and f_end is not null and filing_date is not null").select(F.explode(keys).alias("key"), "accession", "f_end", "filing_date", "amended", "covered", F.coalesce("bits", F.lit(0)).alias("bits"))
    # a filing of an older period than the newest one changes nothing from then on
    newest = keyed.withColumn("__newest", F.max("f_end").over(Window.partitionBy("key").orderBy("filing_date"))).filter("f_end = __newest")
    so_far = Window.partitionBy("key", "f_end").orderBy("filing_date", "accession").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(F.when(c, F.col("accession")), ignorenulls=True).over(so_far)
    seen = newest.select("key", "filing_date", "accession", F.max("covered").over(so_far).alias("covered"), F.first("accession").over(so_far).alias("oldest"), last(F.col("amended")).alias("amendment"), *[last(F.getbit("bits", F.lit(i)) == 1).alias(f"__{i}") for i in range(len(METRICS))])
    by = [F.coalesce(f"__{i}", "oldest") for i in range(len(METRICS))]
    part = lambda x: F.struct(x.alias("accession"), reduce(lambda p, q: p + q, [F.when(c == x, F.lit(1 << i)).otherwise(0) for i, c in enumerate(by)]).alias("bits"))
    kind = "struct<reason:string,amendment:string,parts:array<struct<accession:string,bits:int>>>"
    state = F.when(F.col("covered"), F.struct(F.lit(None).cast("string").alias("reason"), F.col("amendment"), F.transform(F.array_distinct(F.array(*by)), part).alias("parts")).cast(kind))
    none = lambda why: F.struct(F.lit(why).alias("reason"), F.lit(None).alias("amendment"), F.lit(None).alias("parts")).cast(kind)
    before = keyed.select("key").distinct().select("key", F.date_add(F.lit("0001-01-01").cast("date"), -1).alias("day"), F.lit("").alias("accession"), none("period_not_filed_as_of").alias("state"))
    return seen.select("key", F.col("filing_date").alias("day"), "accession", F.coalesce(state, none("period_not_covered")).alias("state")).unionByName(before)


def settle(requests: DataFrame, settled: DataFrame, current_year: int, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Every request with its figures: its columns and metric, status, reason, the fields of the hit, accession, fiscal_label, restated, amendment_accession, end_date, filing_date, form_type.

    ``requests`` hold ticker, kind, label, period_end and as_of; those with a column ``metric`` ask for that one, others
    for all ``metrics``, a row each. They are met before they are multiplied by metrics, and carry nothing but
    accessions until the last join.
    """
    own = "metric" in requests.columns
    asked_for = F.when(F.col("kind").isin("fiscal_label", "calendar_year"), F.col("label").cast("string")).when(F.col("kind") == "period_end", F.col("period_end").cast("string")).otherwise("")
    known_kind = F.when(F.col("kind").isin("fiscal_label", "calendar_year", "period_end"), F.col("kind")).otherwise("latest")
    r = requests.withColumn("ticker", F.upper("ticker")).withColumn("__day", F.coalesce(F.col("as_of").cast("date"), F.lit(ALWAYS).cast("date")))
    r = r.withColumn("__key", F.concat(F.col("ticker"), F.lit("|"), known_kind, F.lit("|"), asked_for))

    asks = r.filter("__key is not null").select(F.col("__key").alias("key"), F.col("__day").alias("day")).distinct()
    timeline = _timeline(settled)
    marks = timeline.withColumn("ask", F.lit(0)).unionByName(asks.select("key", "day", F.lit("").alias("accession"), F.lit(None).cast(timeline.schema["state"].dataType).alias("state"), F.lit(1).alias("ask")))
    so_far = Window.partitionBy("key").orderBy("day", "ask", "accession").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    states = marks.withColumn("state", F.last("state", ignorenulls=True).over(so_far)).filter("ask = 1").select(F.col("key").alias("__key"), F.col("day").alias("__day"), F.col("state").alias("__state"))
    tickers = settled.select("ticker").distinct().withColumn("__known", F.lit(True))
    met = r.join(states, ["__key", "__day"], "left").join(broadcast_if_small(tickers, tickers.count(), 64), "ticker", "left")

    at = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(METRICS) for x in (m, i)]), F.col("metric")) if own else F.lit(None).cast("int")
    wanted = F.coalesce(F.call_function("shiftleft", F.lit(1), at), F.lit(0)) if own else F.lit(sum(1 << METRICS.index(m) for m in metrics))
    parts = F.filter("__state.parts", lambda p: p.getField("bits").bitwiseAND(wanted) != 0)
    nothing = F.array(F.struct(F.lit(None).cast("string").alias("accession"), wanted.alias("bits")))
    met = met.withColumn("__part", F.explode(F.when(F.size(parts) > 0, parts).otherwise(nothing)))
    met = met.select(*[c for c in r.columns if c not in ("__key", "__day")], F.col("__known"), F.col("__state").isNotNull().alias("__filed"), F.col("__state.reason").alias("__reason"), F.col("__state.amendment").alias("__amendment"), F.col("__part.accession").alias("__accession"), F.col("__part.bits").alias("__bits"))
    filing = settled.select(F.col("accession").alias("__accession"), "figures", F.col("fiscal_label").alias("__label"), "amended", "f_end", F.col("filing_date").alias("__filed_on"), F.col("form_type").alias("__form"))
    full = met.join(filing, "__accession", "left")
    if own:
        full = full.withColumn("__at", at)
    else:
        full = full.withColumn("__at", F.explode(F.filter(F.array(*[F.lit(METRICS.index(m)) for m in metrics]), lambda i: F.getbit("__bits", i) == 1))).withColumn("metric", F.get(F.array(*[F.lit(m) for m in METRICS]), F.col("__at")))
    full = full.withColumn("__figure", F.get("figures", F.col("__at")))
    late = F.col("kind").isin("fiscal_label", "calendar_year") & (F.col("label") > current_year)
    reason = (
        F.when(F.col("__at").isNull(), "metric_not_supported").when(F.col("__known").isNull(), "company_not_found").when(~F.col("__filed") & late, "future_period").when(~F.col("__filed"), "period_not_covered")
        .when(F.col("__reason").isNotNull(), F.col("__reason")).when(F.col("__figure.hit").isNull(), F.coalesce("__figure.reason", F.lit("metric_not_found_in_filing")))
    )
    full = full.withColumn("reason", reason)
    good = lambda c: F.when(F.col("reason").isNull(), c)
    hit = settled.schema["figures"].dataType.elementType["hit"].dataType.names
    return full.select(
        *requests.columns, *[] if own else ["metric"], F.when(F.col("reason").isNull(), "resolved").otherwise("abstained").alias("status"), "reason", *[good(F.col(f"__figure.hit.{c}")).alias(c) for c in hit],
        good(F.col("__accession")).alias("accession"), good(F.col("__label")).alias("fiscal_label"), good(F.col("amended")).alias("restated"), good(F.when(~F.col("__amendment").eqNullSafe(F.col("__accession")), F.col("__amendment"))).alias("amendment_accession"),
        good(F.col("f_end")).alias("end_date"), good(F.col("__filed_on")).alias("filing_date"), good(F.col("__form")).alias("form_type"),
    )


def resolve(requests: DataFrame, filings: DataFrame, store: DataFrame, current_year: int) -> DataFrame:
    """One row per request: (request_id, metric, ticker, status, reason, value, unit, concept, rule, scale_raw, accession, fiscal_label, restated, amendment_accession).

    ``requests`` hold request_id (unique), ticker, metric, kind (fiscal_label, calendar_year, period_end,
    latest), label, period_end and as_of; ``store`` holds each filing's own-period facts. A null as_of
    sets no bound. Public filings of the newest period are tried newest first; the first that resolves
    wins, else the reason of the oldest counts. ``amendment_accession`` names the newest public amendment
    of the period if it isn't the filing that won. Repeated listings count once; requests without a
    ticker know no company.
    """
    full = settle(requests.select("request_id", "ticker", "metric", "kind", "label", "period_end", "as_of"), settled_filings(filings, store), current_year)
    return full.select("request_id", "metric", "ticker", "status", "reason", "value", "unit", "concept", "rule", "scale_raw", "accession", "fiscal_label", "restated", "amendment_accession")


def validate(resolved: DataFrame, statements: DataFrame) -> DataFrame:
    """``resolved`` with ``validation_status``: whether the figure is printed in its filing's statement.

    ``statements`` hold (ticker, fiscal_label, statement, text), one row each. validated: a printed form
    of the figure at its tagged scale stands in the text; unvalidated: there is no text or it holds
    fewer than ``LEAST_NUMERALS`` numerals; else conflict. The value is never changed. Each distinct
    figure of a statement is looked up once, so a text meets it once, however many requests share it.
    """
    spark = resolved.sparkSession
    kind = F.broadcast(registry.statements(spark))
    asked = resolved.join(kind, "metric", "left")
    figures = asked.filter("status = 'resolved'").select("ticker", "fiscal_label", "statement", "value", "scale_raw").distinct()
    power = F.coalesce(F.trim("scale_raw").try_cast("int"), F.lit(0))
    step = F.concat(F.lit("1E"), (-power).cast("string")).try_cast("decimal(38,10)")
    shown = F.abs("value").cast("decimal(28,10)") * step.cast("decimal(20,10)")
    forms = F.array(fmt.grouped(shown.cast("decimal(38,10)")), fmt.plain(shown.cast("decimal(38,10)")))
    flat = statements.select("ticker", "fiscal_label", "statement", F.regexp_replace("text", "[\\s\u00a0]+", " ").alias("__flat"))
    read = flat.withColumn("__numerals", F.size(F.regexp_extract_all("__flat", F.lit(r"(\d{1,3}(?:,\d{3})+|\d{4,})"), F.lit(1))))
    judged = figures.join(read, ["ticker", "fiscal_label", "statement"]).select("ticker", "fiscal_label", "statement", "value", "scale_raw", F.exists(forms, lambda x: F.contains(F.col("__flat"), x)).alias("__printed"), "__numerals")
    keys = ["ticker", "fiscal_label", "statement", "value", "scale_raw"]
    on = reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"j.{k}")) for k in keys])
    full = asked.alias("a").join(judged.alias("j"), on, "left")
    status = F.when(F.col("j.__printed"), "validated").when(F.coalesce(F.col("j.__numerals"), F.lit(0)) < LEAST_NUMERALS, "unvalidated").otherwise("conflict")
    return full.select(*[F.col(f"a.{c}") for c in resolved.columns], F.when(F.col("a.status") == "resolved", status).alias("validation_status"))


def coverage(resolved: DataFrame) -> DataFrame:
    """(status, reason, n, share) of resolutions."""
    counts = resolved.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))
