"""Scoring of answers: figures in prose, citations, refusals, sections, and the tables that sum them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numerals
from .evaluate import citation_flags, wilson

MONEY = "decimal(38,10)"
#: Citations of an answer.
CITATION = "array<struct<index: bigint, kind: string, metric: string, value: string, accession: string, filing_date: string, section: string>>"
# Display titles of sections and their ids.
TITLES = {
    "item 1: business": "item_1_business", "item 1a: risk factors": "item_1a_risk_factors", "item 1b: unresolved staff comments": "item_1b_staff", "item 1c: cybersecurity": "item_1c_cyber", "item 2: properties": "item_2_properties", "item 3: legal proceedings": "item_3_legal", "item 4: mine safety": "item_4_mine",
    "item 5: market for equity": "item_5_market", "item 6: selected financial data": "item_6_selected", "item 7: md&a": "item_7_mda", "item 7a: quantitative disclosures": "item_7a_market_risk", "item 8: financial statements": "item_8_financials", "item 9: disagreements with accountants": "item_9_accountants",
    "item 9a: controls and procedures": "item_9a_controls", "item 9b: other information": "item_9b_other", "items 10-14: corporate governance": "item_governance", "item 15: exhibits": "item_15_exhibits",
}
#: A refusal that states a quantity: currency, grouped digits, a percentage or a magnitude.
FIGURE = r"(?i)(?<![\w.])(?:[$€£]\s*\d|\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?\s*%|\d+(?:\.\d+)?\s*(?:percent|trillion|billion|million|thousand)\b)"
ANSWERED, ABSTAINED = ("answered", "answered_text"), ("abstained", "clarification_needed")


def match_value(text: Column, expected: Column, tolerance_rel: Column | None = None, tolerance_abs: Column | None = None, percent: Column | None = None, distractors: Column | None = None) -> Column:
    """What the figures of a text are against the expected one, the first that applies.

    correct: a figure rounds to it as shown, or lies within a tolerance; unit_error (where percent is
    asked for): a fraction in place of a percentage or the reverse, within a thousandth; sign_error;
    scale_error: off by ten to a power of 1 to 12 within the precision shown, by two significant
    digits or more; wrong_entity and wrong_period: the figure of one of ``distractors``, an array of
    (kind, value) in order; else wrong_value; missing_number without any figure. Sign and scale are
    judged figure by figure, in the order of the text. A null expected figure is never met.
    """
    e = expected.cast(MONEY)
    d = e.cast("double")

    def judge(found: Column) -> Column:
        value = lambda x: x.getField("value")
        near = lambda x, t: F.coalesce(F.abs(value(x) - t) * 2 <= x.getField("step"), F.lit(False))
        off = lambda x: F.abs(value(x).cast("double") - d)
        right = F.exists(found, lambda x: near(x, e))
        if tolerance_abs is not None:
            right = right | F.exists(found, lambda x: F.coalesce(F.abs(value(x) - e) <= tolerance_abs.cast(MONEY), F.lit(False)))
        if tolerance_rel is not None:
            right = right | F.exists(found, lambda x: F.coalesce((tolerance_rel > 0) & (off(x) <= tolerance_rel * F.abs(d)), F.lit(False)))
        out = F.when(F.size(found) == 0, "missing_number").when(right, "correct")
        if percent is not None:
            v = lambda x: value(x).cast("double")
            unit = F.exists(found, lambda x: F.coalesce((v(x) != 0) & ((F.abs(v(x) * 100 - d) < 0.001 * F.abs(d)) | (F.abs(v(x) / 100 - d) < 0.001 * F.abs(d))), F.lit(False)))
            out = out.when(percent & unit, "unit_error")
        out = out.when(first_defect(found, e).isNotNull(), first_defect(found, e))
        if distractors is not None:
            other = F.filter(distractors, lambda o: F.exists(found, lambda x: near(x, o.getField("value").cast(MONEY))))
            kind = F.get(other, F.lit(0)).getField("kind")
            out = out.when(kind == "entity", "wrong_entity").when(kind.isNotNull(), "wrong_period")
        return out.otherwise("wrong_value")

    return F.get(F.transform(F.array(numerals.numerals(text)), judge), F.lit(0))


def first_defect(found: Column, e: Column) -> Column:
    """sign_error or scale_error of the first figure that has one, else null."""
    d = e.cast("double")

    def defect(x: Column) -> Column:
        v = x.getField("value").cast("double")
        digits = F.regexp_replace(F.get(F.split(x.getField("raw"), "e"), F.lit(0)), "[^0-9]", "")
        kept = F.length(F.regexp_replace(digits, "^0+", ""))
        written = F.when(kept > 0, kept).otherwise(F.length(digits))
        slack = x.getField("step").cast("double") / 2 / F.abs(v) * F.abs(d)
        powers = F.array(*[F.lit(float(f"1e{p}")) for m in range(1, 13) for p in (m, -m)])
        scale = F.exists(powers, lambda k: F.abs(v * k - d) <= slack)
        sign = F.abs(x.getField("value") + e) * 2 <= x.getField("step")
        return F.when((v != 0) & (d != 0), F.when(sign, "sign_error").when((written >= 2) & scale, "scale_error"))

    return F.get(F.array_compact(F.transform(found, defect)), F.lit(0))


def fact_values(citations: Column) -> Column:
    """Figures that fact citations carry."""
    facts = F.filter(F.coalesce(citations, F.array().cast(CITATION)), lambda c: c.getField("kind") == "fact")
    return F.array_compact(F.transform(facts, lambda c: F.nullif(c.getField("value"), F.lit("")).try_cast(MONEY)))


def _unanswered(status: Column) -> Column:
    return F.when(status.isin(*ABSTAINED), "abstained_wrongly").when(~F.coalesce(status.isin(*ANSWERED), F.lit(False)), F.when(status == "error", "error").otherwise("not_run"))


def _scored(verdict: Column, flags: Column) -> Column:
    return F.struct(verdict.alias("verdict"), F.array_sort(F.array_distinct(flags)).alias("flags"))


def base_flags(status: Column, citations: Column, as_of: Column) -> Column:
    """Flags of an answer's citations, whatever its category."""
    slim = F.transform(citations, lambda c: F.struct(c.getField("index").alias("index"), c.getField("accession").alias("accession"), c.getField("filing_date").alias("filing_date")))
    return citation_flags(slim, F.coalesce(status.isin(*ABSTAINED), F.lit(False)), as_of)


def score_numeric(status: Column, answer: Column, citations: Column, as_of: Column, expected: Column, metric: Column, tolerance_rel: Column | None = None, distractors: Column | None = None) -> Column:
    """Struct (verdict, flags) of an answer to a question for one figure.

    A fact citation with exactly the figure is correct; citations of other metrics only are wrong_metric;
    a figure in prose alone is correct_text_only with the flag uncited_number.
    """
    cited = F.exists(fact_values(citations), lambda v: v == expected.cast(MONEY))
    named = F.array_compact(F.transform(F.filter(F.coalesce(citations, F.array().cast(CITATION)), lambda c: c.getField("kind") == "fact"), lambda c: F.nullif(c.getField("metric"), F.lit(""))))
    other = metric.isNotNull() & (F.size(named) > 0) & ~F.array_contains(named, F.coalesce(metric, F.lit("")))
    prose = match_value(answer, expected, tolerance_rel, None, None, distractors)
    answered = F.coalesce(status.isin(*ANSWERED), F.lit(False))
    told = answered & ~F.coalesce(cited, F.lit(False)) & ~F.coalesce(other, F.lit(False)) & (prose == "correct")
    verdict = F.coalesce(_unanswered(status), F.when(cited, "correct"), F.when(other, "wrong_metric"), F.when(prose == "correct", "correct_text_only"), prose)
    return _scored(verdict, F.when(told, F.array_append(base_flags(status, citations, as_of), F.lit("uncited_number"))).otherwise(base_flags(status, citations, as_of)))


def score_computed(status: Column, answer: Column, citations: Column, as_of: Column, expected: Column, percent: Column, tolerance_rel: Column | None = None, tolerance_abs: Column | None = None, distractors: Column | None = None) -> Column:
    """Struct (verdict, flags) of an answer to a question for a calculation; it must cite the facts it was made of."""
    prose = match_value(answer, expected, tolerance_rel, tolerance_abs, percent, distractors)
    verdict = F.coalesce(_unanswered(status), prose)
    bare = (verdict == "correct") & (F.size(fact_values(citations)) == 0)
    return _scored(verdict, F.when(bare, F.array_append(base_flags(status, citations, as_of), F.lit("uncited_number"))).otherwise(base_flags(status, citations, as_of)))


def score_multi(answers: DataFrame, ident: str, values: DataFrame) -> DataFrame:
    """(ident, verdict, correct, expected, flags) of answers to comparisons and trends.

    ``answers`` hold ident (unique), status, answer, citations and as_of; ``values`` hold ident, label and
    value. Every expected value is judged with the item's others as distractors; all right is correct,
    some right partial_multi, none wrong_value.
    """
    others = values.groupBy(ident).agg(F.collect_list(F.struct("label", "value")).alias("__all"))  # the few values of one item
    j = answers.join(others, ident).withColumn("v", F.explode("__all"))
    rest = F.transform(F.filter("__all", lambda o: o.getField("label") != F.col("v.label")), lambda o: F.struct(F.lit("entity").alias("kind"), o.getField("value").alias("value")))
    cited = F.exists(fact_values(F.col("citations")), lambda x: x == F.col("v.value").cast(MONEY))
    right = F.coalesce(cited, F.lit(False)) | (match_value(F.col("answer"), F.col("v.value"), distractors=rest) == "correct")
    per = j.withColumn("__ok", right).groupBy(ident).agg(F.count_if("__ok").alias("correct"), F.count(F.lit(1)).alias("expected"))
    verdict = F.coalesce(_unanswered(F.col("status")), F.when(F.col("correct") == F.col("expected"), "correct").when(F.col("correct") > 0, "partial_multi").otherwise("wrong_value"))
    return answers.join(per, ident).select(ident, verdict.alias("verdict"), "correct", "expected", base_flags(F.col("status"), F.col("citations"), F.col("as_of")).alias("flags"))


def states_a_figure(text: Column) -> Column:
    """True if a refusal states a quantity; years and dates are none."""
    return F.coalesce(text, F.lit("")).rlike(FIGURE)


def score_abstain(status: Column, answer: Column, citations: Column, as_of: Column, reason: Column, expected_reason: Column, allow_clarification: Column) -> Column:
    """Struct (verdict, flags) of the answer to a question that must be refused for a reason."""
    asked_back = F.coalesce(allow_clarification, F.lit(False)) & (status == "clarification_needed")
    verdict = F.when(status.isNull(), "not_run").when(status == "error", "error").when(status.isin(*ANSWERED), "answered_wrongly").when(asked_back, "correct_abstain").when(reason.eqNullSafe(expected_reason), "correct_abstain").otherwise("wrong_abstain_reason")
    figure = ~F.coalesce(status.isin(*ANSWERED, "error"), F.lit(True)) & ~F.coalesce(asked_back, F.lit(False)) & states_a_figure(answer)
    flags = base_flags(status, citations, as_of)
    return _scored(verdict, F.when(figure, F.array_append(flags, F.lit("abstention_with_number"))).otherwise(flags))


def normal_section(name: Column) -> Column:
    """Section id of an id with or without its part number, or of a display title."""
    base = F.get(F.split(F.trim(F.coalesce(name, F.lit(""))), "__"), F.lit(0))
    known = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(base)), base)


def section_rank(cited: Column, expected: Column, k: int = 5) -> Column:
    """Position of the first of the first ``k`` cited sections that is an expected one; null if none is."""
    wanted = F.transform(expected, normal_section)
    at = F.filter(F.transform(F.slice(cited, 1, k), lambda s, i: F.when(F.array_contains(wanted, normal_section(s)), i + 1)), lambda i: i.isNotNull())
    return F.array_min(at)


def score_text(status: Column, answer: Column, citations: Column, as_of: Column, expected_sections: Column, must_contain: Column, k: int = 5) -> Column:
    """Struct (verdict, flags) of a narrative answer: a required figure is missing, or no section among the first ``k`` is expected."""
    found = numerals.numerals(answer)
    lacking = F.exists(F.coalesce(must_contain, F.array().cast("array<string>")), lambda m: ~F.exists(found, lambda x: F.coalesce(F.abs(x.getField("value") - m.try_cast(MONEY)) * 2 <= x.getField("step"), F.lit(False))))
    named = F.transform(F.filter(F.coalesce(citations, F.array().cast(CITATION)), lambda c: F.coalesce(c.getField("section"), F.lit("")) != ""), lambda c: c.getField("section"))
    verdict = F.when(status.isNull(), "not_run").when(status == "error", "error").when(status.isin(*ABSTAINED), "abstained_wrongly").when(~status.isin(*ANSWERED), "not_run").when(lacking, "wrong_value").when(section_rank(named, expected_sections, k).isNull(), "wrong_value").otherwise("correct")
    return _scored(verdict, base_flags(status, citations, as_of))


def run_join(gold: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """Every gold item with its last run's outcome; items without one are ``not_run``. ``runs`` hold key, at, status."""
    last = runs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("at", "status")).alias("__r"))
    return gold.join(last, key, "left").select(*gold.columns, F.coalesce("__r.status", F.lit("not_run")).alias("run_status"))


def verdict_totals(scored: DataFrame, category: str) -> DataFrame:
    """(category, verdict, n, share): verdict counts per category and, under a null category, overall."""
    counts = scored.groupBy(category, "verdict").agg(F.count(F.lit(1)).alias("n"))
    both = counts.unionByName(counts.groupBy("verdict").agg(F.sum("n").alias("n")).select(F.lit(None).cast(dict(scored.dtypes)[category]).alias(category), "verdict", "n"))
    return both.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(category)), 6))


def flag_totals(scored: DataFrame, flags: str) -> DataFrame:
    """(flag, n) over all answers; an answer counts once a flag."""
    return scored.select(F.explode(F.array_distinct(flags)).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def gold_oracle(gold: DataFrame, oracle: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Gold rows (keys, value) with ``verified_by``: companyfacts where the oracle states the value, auto where it states none.

    A value that the oracle contradicts is ``mismatch``, or raises if ``strict``. Of several oracle values any equal one counts.
    """
    o = oracle.select(*keys, F.col("value").alias("__o")).distinct()
    seen = gold.join(o, keys, "left").groupBy(*gold.columns).agg(F.bool_or(F.col("__o") == F.col("value")).alias("__same"), F.count("__o").alias("__n"))
    wrong = F.raise_error(F.lit("a gold value differs from the oracle")).cast("string") if strict else F.lit("mismatch")
    return seen.select(*gold.columns, F.when(F.col("__n") == 0, "auto").when(F.col("__same"), "companyfacts").otherwise(wrong).alias("verified_by"))


def apply_sheet(gold: DataFrame, sheet: DataFrame, key: str) -> DataFrame:
    """(key, outcome): owner for a signed OK, else the error of the row: unknown_id, wrong or unsigned. Gold rows without a sheet row are left out."""
    known = gold.select(key).distinct().withColumn("__known", F.lit(True))
    v = F.upper(F.trim(F.coalesce("verdict", F.lit(""))))
    return sheet.join(known, key, "left").select(key, F.when(F.col("__known").isNull(), "unknown_id").when(v == "WRONG", "wrong").when(v == "OK", "owner").otherwise("unsigned").alias("outcome"))


def sections_ready(items: DataFrame, ident: str, sections: str, keys: list[str], audit: DataFrame) -> DataFrame:
    """(ident, ready, problems): whether all expected sections of an item were audited as ok; problems name the others, sorted."""
    wanted = items.select(ident, *keys, F.explode(sections).alias("section_id"))
    j = wanted.join(audit.select(*keys, "section_id", "verdict"), [*keys, "section_id"], "left")
    bad = F.when(F.coalesce(F.col("verdict"), F.lit("missing")) != "ok", F.concat_ws(":", "section_id", F.coalesce("verdict", F.lit("missing"))))
    return j.groupBy(ident).agg(F.array_join(F.array_sort(F.collect_set(bad)), ",").alias("problems")).select(ident, (F.col("problems") == "").alias("ready"), "problems")


def exact_rate(classified: DataFrame, verdict: str) -> DataFrame:
    """(comparable, exact, rate): exact agreements among those that the oracle states."""
    comparable = F.count_if(F.col(verdict) != "not_in_oracle")
    exact = F.count_if(F.col(verdict) == "exact")
    return classified.agg(comparable.alias("comparable"), exact.alias("exact"), F.round(F.try_divide(exact, comparable), 6).alias("rate"))


def arm_decision(arms: DataFrame, base: str, points: float = 0.05, drop: float = 0.03, faster: float = 10.0) -> DataFrame:
    """(arm, accepted): an arm may replace the base if its hit rate lies within ``points``, its MRR falls by no more than ``drop`` and it is ``faster`` times as fast."""
    b = arms.filter(F.col("arm") == base).select(F.col("hit_rate").alias("__h"), F.col("mrr").alias("__m"), F.col("seconds").alias("__s"))
    ok = (F.col("__h") - F.col("hit_rate") <= points) & (F.col("__m") - F.col("mrr") <= drop) & (F.col("__s") >= faster * F.col("seconds"))
    return arms.crossJoin(F.broadcast(b)).select("arm", F.coalesce(ok, F.lit(False)).alias("accepted"))  # one row of the base


def accuracy_with_interval(scored: DataFrame, category: str) -> DataFrame:
    """(category, n, correct, low, high): answers counted correct, with the score interval."""
    g = scored.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict").startswith("correct")).alias("correct"))
    w = wilson(F.col("correct"), F.col("n"))
    return g.select(category, "n", "correct", F.round(w.getField("low"), 6).alias("low"), F.round(w.getField("high"), 6).alias("high"))
