"""Deterministic reading of a question: period, focus, computation, metric mentions and path.

Everything is built from regular expressions as column expressions, so whole tables of questions are
read inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.registry import METRICS
from .phrases import any_of, phrase

# Phrases by which a question names a period.
SUB_ANNUAL = any_of("q1|q2|q3|q4, first|second|third|fourth|1st|2nd|3rd|4th quarter, quarterly, quarter ended|ending|of, 10-q, 10q, three|six|nine month/s ended|ending, h1|h2, first|second half, half year, half-year, interim result/s|period|financial, month|monthly ended|ending")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
JOINERS = ("to", "through", "thru", "until", "till", "and", "-", "–", "—", "=>", "→")
_AD = r"(?:19|20)\d{2}"
_FISCAL_LEAD = r"(?:fiscal\s+|fy\s*)?"
AS_OF = "(?:" + "|".join(phrase(p) for p in ("as of|at", "as was known on|at", "on the date", "knowing only")) + ")"
ENDED = "(?:" + "|".join(phrase(p) for p in ("fiscal year|period ended|ending", "year|period ended|ending", "for the year to")) + ")"
RANGE = rf"(?i)\b(?:from\s+|between\s+)?{_FISCAL_LEAD}({_AD})\s*(?:{'|'.join(JOINERS)})\s*{_FISCAL_LEAD}({_AD})\b"
FISCAL = r"(?i)\b(?:fiscal\s+year|fiscal|fy)\s*[-:]?\s*(\d{4}|\d{2})\b"
CALENDAR = r"(?i)\bcalendar(?:\s+year)?\s*[-:]?\s*(\d{4})\b"
YEAR = rf"\b({_AD})\b"
NUMBER_WORDS = {"two": 2, "three": 3, "four": 4, "five": 5}
LAST_N = rf"(?i)\b(?:last|past|previous|trailing)\s+(\d+|{'|'.join(NUMBER_WORDS)})\s+(?:fiscal\s+)?years?\b"
LATEST = any_of("latest, most recent/ly, newest, current, last reported, last report|filing|10-k, last annual report|filing|10-k")
EARLIEST = 1993

# What a question is about, in order of precedence.
FOCUS = (
    ("risk_factors", any_of("risk/s, threat/s, exposure/s, worr//y/ies/ied, uncertaint//y/ies, headwind/s")),
    ("legal_proceedings", any_of("legal, litigation, lawsuit/s, proceeding/s, sue/d, settlement/s, regulatory action")),
    ("cybersecurity", any_of("cyber/security, data breach, information security, ransomware")),
    ("segment_info", any_of("segment/s, geograph//y/ic/ies")),
    ("balance_sheet", any_of("balance sheet, liquidity, capital structure")),
    ("business_overview", any_of("business, product/s, strateg//y/ies/ic, competit//ion/or/ors/ive, employee/s, market/s served, operation/s", r"\bwhat\s+does\s+.*\bsell\b")),
)
COMPUTATION = (
    ("cagr_pct", any_of("cagr, compound/ed annual")),
    ("margin_pct", any_of("margin/s, as a percentage|percent|share|% of, percent/age of revenue|sales")),
    ("growth_pct", any_of("grow/th/n, grew, increase/s/d, decrease/s/d, decline/s/d, rose, fell, change/s/d, year over year, yoy")),
    ("ratio", any_of("ratio, divided by, per dollar")),
    ("difference", any_of("difference, how much more|less|higher|lower, gap, minus, subtract/ing/ed", r"\bless\b(?!\s+than)")),
    ("sum", any_of("combined, together, sum of, total of")),
)
MARGINS = ((any_of("gross margin/s, gross profit margin/s"), "gross_profit"), (any_of("operating margin/s, operating profit|income margin/s"), "operating_income"), (any_of("net margin/s, net profit|income margin/s, profit margin/s"), "net_income"))
TREND = any_of("trend/ed/s/ing, over time, year by year, by year, over the last|past, histor//y/ical, move/d/s, evolv//e/ed/ing", rf"\bfrom\s+\d{{4}}\s*(?:to|through|-)\s*\d{{4}}\b")
COMPARE = any_of("compare/d/s, comparison, versus, vs, against, which of|company|one, between, relative to")
NARRATIVE = any_of("discuss/es/ed, disclos//e/es/ed/ure/ures, describe/s/d, explain/s/d, summar//y/ise/ize/ises/izes, tell me about, why", r"\bwhat\s+(?:does|do|did)\b.*\b(?:say|disclose|describe|discuss|mention)\b", r"\bhow\s+does\s+.*\bmanage\b")
NUMERIC = any_of("how much, how many, how large, what was|were|is|are total|amount|figure|value|number|dollar, what was|were|is|are the total|amount|figure|value|number|dollar, in dollars, figure for", r"\$\s*\d")
OUT_OF_SCOPE = any_of("should i buy|sell|invest|hold, a good|bad buy|investment|stock|bet, price target, stock|share price, forecast, predict, recommend/ation, portfolio advice, market cap, dividend yield, analyst rating, worth buying|investing, valuation multiple", r"\bwill\s+.*\bgo\s+(?:up|down)\b", r"\bp/?e\s+ratio\b")
QUALIFIERS = ("deferred", "unearned", "unbilled", "contract", "cost", "costs", "adjusted", "nongaap", "pro", "forma", "projected", "estimated", "forecast", "forecasted", "expected", "budgeted", "normalized", "normalised", "segment", "incremental", "average", "annualized", "annualised", "remaining", "accrued", "prepaid", "restricted")
LINKERS = ("of", "for", "in", "on", "to", "the")


def first_match(text: Column, rules: tuple, default: str | None) -> Column:
    """Name of the first rule whose pattern occurs in the text."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def focus(text: Column) -> Column:
    return first_match(text, FOCUS, "other")


def computation(text: Column) -> Column:
    return first_match(text, COMPUTATION, None)


def margin_metric(text: Column) -> Column:
    return first_match(text, tuple((m, p) for p, m in MARGINS), None)


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _month(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m[:3], f"{i:02d}")]), F.lower(F.substring(name, 1, 3)))


_NAME = r"((?:jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec)|" + "|".join(MONTHS) + r")"
_GAP = r"[\s,:]*(?:the\s+)?"
_DATES = (r"(\d{4})-(\d{2})-(\d{2})\b", rf"\b{_NAME}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{_NAME},?\s+(\d{{4}})\b")


def date_after(text: Column, lead: str) -> Column:
    """First real date that a lead phrase introduces: ISO, month-day-year or day-month-year."""
    pat = [f"(?i){lead}{_GAP}{p}" for p in _DATES]
    g = lambda i, n: F.regexp_extract(text, pat[i], n)
    day = lambda x: F.lpad(x, 2, "0")
    iso = F.concat_ws("-", g(0, 1), g(0, 2), g(0, 3))
    mdy = F.concat_ws("-", g(1, 3), _month(g(1, 1)), day(g(1, 2)))
    dmy = F.concat_ws("-", g(2, 3), _month(g(2, 2)), day(g(2, 1)))
    return F.coalesce(*[F.when(F.length(x) == 10, x).try_cast("date") for x in (iso, mdy, dmy)])


def without_date(text: Column, lead: str) -> Column:
    for p in _DATES:
        text = F.regexp_replace(text, f"(?i){lead}{_GAP}{p}", " ")
    return text


def period(question: Column, year: int) -> Column:
    """Struct (kind, labels, period_end, as_of, reason) of the period a question names, as seen in ``year``.

    Phrases of less than a year are refused first; the as-of date is taken out before years are read;
    then year ended, range, fiscal, calendar, bare and relative years and the latest filing, in this
    order. Null reads as an empty question.
    """
    none, nothing, no_reason = F.array().cast("array<int>"), F.lit(None).cast("date"), F.lit(None).cast("string")
    some = lambda c: F.size(c) > 0

    def known(s: Column) -> Column:
        """The text without its as-of date, and that date."""
        return F.struct(s.getField("q").alias("q"), s.getField("as_of").alias("as_of"), F.when(s.getField("as_of").isNotNull(), without_date(s.getField("q"), AS_OF)).otherwise(s.getField("q")).alias("text"))

    def read(s: Column) -> Column:
        """All years the text names, by kind of phrase."""
        text = s.getField("text")
        ints = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
        a, b = (F.nullif(F.regexp_extract(text, RANGE, n), F.lit("")).cast("int") for n in (1, 2))
        raw = F.lower(F.regexp_extract(text, LAST_N, 1))
        words = F.create_map(*[x for w, k in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(k))])
        rel = F.when(text.rlike(r"(?i)\blast\s+year\b|\b(?:prior|previous)\s+year\b"), year - 1).when(text.rlike(r"(?i)\bthis\s+year\b"), year)
        return F.struct(
            s.getField("q").rlike(SUB_ANNUAL).alias("short"), s.getField("as_of").alias("as_of"), date_after(text, ENDED).alias("ended"), let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.sequence(F.least(x.getField("a"), x.getField("b")), F.greatest(x.getField("a"), x.getField("b")))).alias("range"),
            F.transform(ints(FISCAL), lambda y: F.when(y < 100, y + 2000).otherwise(y)).alias("fiscal"), ints(CALENDAR).alias("calendar"), ints(YEAR).alias("bare"), F.coalesce(raw.try_cast("int"), F.element_at(words, raw)).alias("n"), rel.alias("rel"), text.rlike(LATEST).alias("latest"),
        )

    def label(s: Column) -> Column:
        f = s.getField
        labels = F.when(f("range").isNotNull(), f("range")).when(some(f("fiscal")), f("fiscal")).when(some(f("calendar")), f("calendar")).when(some(f("bare")), f("bare"))
        kind = F.when(f("range").isNull() & ~some(f("fiscal")) & some(f("calendar")), "calendar_year").otherwise("fiscal_label")
        return F.struct(s.alias("s"), labels.alias("labels"), kind.alias("kind"), F.get(F.filter(labels, lambda y: (y < EARLIEST) | (y > year + 1)), F.lit(0)).alias("bad"))

    def decide(x: Column) -> Column:
        f, labels, bad = x.getField("s").getField, x.getField("labels"), x.getField("bad")
        out = lambda k, ls, end, reason, as_of: F.struct(k.alias("kind"), ls.alias("labels"), end.alias("period_end"), as_of.alias("as_of"), reason.alias("reason"))
        recent = (f("n") >= 1) & (year - f("n") >= EARLIEST)
        return (
            F.when(f("short"), out(F.lit("none"), none, nothing, F.lit("unsupported_period_type"), nothing))
            .when(f("ended").isNotNull(), out(F.lit("period_end"), none, f("ended"), no_reason, f("as_of")))
            .when(bad.isNotNull(), out(F.lit("none"), none, nothing, F.when(bad > year + 1, "future_period").otherwise("period_not_covered"), f("as_of")))
            .when(labels.isNotNull(), out(x.getField("kind"), F.array_sort(F.array_distinct(labels)), nothing, no_reason, f("as_of")))
            .when(F.coalesce(recent, F.lit(False)), out(F.lit("fiscal_label"), F.sequence(year - f("n"), F.lit(year - 1)), nothing, no_reason, f("as_of")))
            .when(f("rel").isNotNull(), out(F.lit("fiscal_label"), F.array(f("rel")), nothing, no_reason, f("as_of")))
            .when(f("latest"), out(F.lit("latest"), none, nothing, no_reason, f("as_of")))
            .otherwise(out(F.lit("none"), none, nothing, no_reason, f("as_of")))
        )

    q = F.coalesce(question, F.lit(""))
    return let(let(let(let(let(q, lambda t: F.struct(t.alias("q"), date_after(t, AS_OF).alias("as_of"))), known), read), label), decide)


def alias_key(text: Column) -> Column:
    """Lower-case letters, digits and single spaces of a phrase."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9& ]", " "), " +", " "))


_ALIASES = sorted(((a, m) for m, (_, _, _, names) in METRICS.items() for a in names), key=lambda x: (-len(x[0]), x[0]))


def metric_mentions(question: Column) -> Column:
    """Struct (named, killed) of the metrics a question mentions, in order, each once.

    At every place the longest alias counts. A mention directly behind a qualifier, or behind a qualifier
    and a linking word, names another figure: its metric is killed unless it is named elsewhere.
    """
    spoilt = "".join(rf"(?<!\b{q} )" + "".join(rf"(?<!\b{q} {k} )" for k in LINKERS) for q in QUALIFIERS)
    listed = "|".join(a.replace("&", r"\&") for a, _ in _ALIASES)
    lookup = F.create_map(*[x for a, m in _ALIASES for x in (F.lit(a), F.lit(m))])
    read = lambda key, lead: F.array_distinct(F.transform(F.regexp_extract_all(key, F.lit(rf"\b{lead}({listed})\b"), F.lit(1)), lambda a: F.element_at(lookup, a)))
    return let(alias_key(F.coalesce(question, F.lit(""))), lambda key: let(read(key, spoilt), lambda named: F.struct(named.alias("named"), F.array_except(read(key, ""), named).alias("killed"))))


def metrics(question: Column) -> Column:
    """Metrics a question names, see ``metric_mentions``; null for a null question."""
    return F.when(question.isNotNull(), metric_mentions(question).getField("named"))


def resolve_alias(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """``names`` with ``metric``: the metric whose alias a name is, exactly, after ``alias_key``; null for others."""
    known = aliases.select(alias_key(F.col("alias")).alias("__a"), "metric").distinct()
    return names.withColumn("__a", alias_key(F.col(name))).join(F.broadcast(known), "__a", "left").drop("__a")  # the registry: a fixed list


def intent(question: Column, tickers: Column, p: Column) -> Column:
    """compare, trend, computed or numeric_fact of a question for a figure."""
    ranged = (F.size(p.getField("labels")) > 1) | question.rlike(TREND)
    return F.when((tickers > 1) | question.rlike(COMPARE), "compare").when(ranged, "trend").when(computation(question).isNotNull(), "computed").otherwise("numeric_fact")


def route(question: Column, tickers: Column, p: Column) -> Column:
    """Struct (path, reason, metrics): where a question goes, and why it is refused or asked back.

    abstain: out of scope, a period that cannot be answered, or a figure that is not among the metrics
    (``metric_not_supported``), also where a ratio lacks its second metric; clarify: no company is named,
    or nothing says what is asked; facts: a metric is named and no text is asked for; else text.
    """
    q = F.coalesce(question, F.lit(""))

    def decide(m: Column) -> Column:
        named, killed = m.getField("named"), m.getField("killed")
        out = lambda path, reason: F.struct(F.lit(path).alias("path"), (F.lit(reason) if reason is None or isinstance(reason, str) else reason).cast("string").alias("reason"), named.alias("metrics"))
        asks_text = q.rlike(NARRATIVE) | (focus(q) != "other")
        unpaired = (F.size(named) < 2) & (F.coalesce(computation(q), F.lit("")) == "ratio") & (F.size(p.getField("labels")) < 2)
        return (
            F.when(q.rlike(OUT_OF_SCOPE), out("abstain", "out_of_scope")).when(p.getField("reason").isNotNull(), out("abstain", p.getField("reason"))).when(tickers == 0, out("clarify", "company_not_found"))
            .when((F.size(named) > 0) & ~q.rlike(NARRATIVE), F.when(unpaired, out("abstain", "metric_not_supported")).otherwise(out("facts", None))).when((F.size(killed) > 0) & q.rlike(NUMERIC), out("abstain", "metric_not_supported"))
            .when(asks_text, out("text", None)).when(q.rlike(NUMERIC), out("abstain", "metric_not_supported")).otherwise(out("clarify", None))
        )

    return let(metric_mentions(q), decide)


def path(question: Column, tickers: Column, p: Column) -> Column:
    """Where a question goes: abstain, clarify, facts or text, see ``route``."""
    return route(question, tickers, p).getField("path")


def selectors(p: Column) -> Column:
    """Array of (kind, label, period_end): the periods to resolve for a question, oldest first.

    A range of fiscal labels asks for each; a calendar year for its first label only; no period asks for the latest.
    """
    labels, kind = p.getField("labels"), p.getField("kind")
    one = lambda k, label, end: F.struct(F.lit(k).alias("kind"), label.cast("int").alias("label"), end.cast("date").alias("period_end"))
    nothing = F.lit(None)
    return (
        F.when((kind == "fiscal_label") & (F.size(labels) > 0), F.transform(labels, lambda y: one("fiscal_label", y, nothing))).when((kind == "period_end") & p.getField("period_end").isNotNull(), F.array(one("period_end", nothing, p.getField("period_end"))))
        .when((kind == "calendar_year") & (F.size(labels) > 0), F.array(one("calendar_year", F.get(labels, F.lit(0)), nothing))).otherwise(F.array(one("latest", nothing, nothing)))
    )


#: Words that begin a sentence and belong to no company's name.
LEADS = ("what", "how", "did", "does", "do", "is", "was", "were", "are", "which", "who", "why", "when", "compare", "summarise", "summarize", "the", "in", "for", "and", "show", "tell", "give", "list", "explain", "describe")


def ticker_tokens(question: Column) -> Column:
    """Words of a question that may be tickers, upper case: signs and final points dropped; shorter than three letters only if written in capitals."""
    words = F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"([A-Za-z0-9&.$]+)"), F.lit(1)), lambda w: F.regexp_replace(F.regexp_replace(w, r"^\$+", ""), r"\.+$", ""))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (w != "") & ((F.length(w) >= 3) | (w == F.upper(w)))), lambda w: F.upper(w)))


def capitalised(question: Column) -> Column:
    """Capitalised phrases of a question that may name a company, without possessives and leading question words."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"(\b\p{Lu}[\p{L}\p{N}&]*(?:\s+\p{Lu}[\p{L}\p{N}&]*)*)"), F.lit(1))
    lead = rf"(?i)^(?:{'|'.join(LEADS)})\s+"
    bare = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, lead, ""), lead, ""))
    return F.array_distinct(F.filter(bare, lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(*LEADS) & ~x.rlike(r"^\d+$")))


def decompose(tickers: Column, years: Column) -> Column:
    """Array of (ticker, year): a question taken apart, every ticker with every distinct year in order; without years once a ticker."""
    ys = F.array_sort(F.array_distinct(F.coalesce(years, F.array().cast("array<int>"))))
    ts = F.array_distinct(F.coalesce(tickers, F.array().cast("array<string>")))
    return F.flatten(F.transform(ts, lambda t: F.when(F.size(ys) == 0, F.array(F.struct(t.alias("ticker"), F.lit(None).cast("int").alias("year")))).otherwise(F.transform(ys, lambda y: F.struct(t.alias("ticker"), y.alias("year"))))))


#: What a model may answer when it is asked where a question goes.
ROUTE_JSON = "struct<query_type: string, tickers: array<string>, years: array<int>, metric: string>"
QUERY_TYPES = ("numeric_fact", "computed", "compare", "trend", "narrative", "clarify", "abstain")


def route_from_json(reply: Column) -> Column:
    """Struct (query_type, tickers, years, metric) of a model's JSON reply; null if it is no JSON or a value is not among those allowed.

    Types and metrics are checked against their lists, years for plausibility; tickers are written in capitals.
    """
    r = F.from_json(reply, ROUTE_JSON)
    years = F.coalesce(r.getField("years"), F.array().cast("array<int>"))
    metric = r.getField("metric")
    valid = F.try_parse_json(reply).isNotNull() & r.getField("query_type").isin(*QUERY_TYPES) & (metric.isNull() | metric.isin(*METRICS)) & ~F.exists(years, lambda y: y.isNull() | (y < EARLIEST) | (y > 2100))
    tickers = F.transform(F.coalesce(r.getField("tickers"), F.array().cast("array<string>")), lambda t: F.upper(t))
    return F.when(F.coalesce(valid, F.lit(False)), F.struct(r.getField("query_type").alias("query_type"), tickers.alias("tickers"), years.alias("years"), metric.alias("metric")))
