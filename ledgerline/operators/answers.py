"""Answer texts from resolved figures: one figure, a calculation, a comparison, a trend, and their notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calc, fmt
from . import registry

#: Columns of a resolved figure that the texts use.
FIGURE = ("ticker", "metric", "fiscal_label", "end_date", "value", "unit", "accession", "filing_date", "form_type", "restated", "amendment_accession")


def label(metric: Column) -> Column:
    """Display label of a metric in lower case, its id where it has none."""
    return F.lower(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in registry.LABELS.items() for x in p]), metric), metric))


def period(fiscal_label: Column, end: Column) -> Column:
    return F.concat(F.lit("fiscal "), F.coalesce(fiscal_label.cast("string"), F.lit("?")), F.lit(" (year ended "), F.coalesce(end.cast("string"), F.lit("?")), F.lit(")"))


def restated_note(r: dict[str, Column]) -> Column:
    """Sentence on a figure that an amendment restated; empty for others."""
    text = F.concat(F.lit(" This figure is restated: it comes from "), r["form_type"], F.lit(" "), r["accession"], F.lit(", filed "), r["filing_date"].cast("string"), F.lit(", which superseded the original filing for fiscal "), r["fiscal_label"].cast("string"), F.lit("."))
    return F.when(F.coalesce(r["restated"], F.lit(False)), F.coalesce(text, F.lit(""))).otherwise("")


def amendment_note(r: dict[str, Column]) -> Column:
    """Sentence on an amendment that leaves the figure as it was; empty where there is none."""
    text = F.concat(F.lit(" An amendment to the fiscal "), r["fiscal_label"].cast("string"), F.lit(" filing exists ("), r["amendment_accession"], F.lit(") but does not restate this figure."))
    return F.when(~F.coalesce(r["restated"], F.lit(False)) & r["amendment_accession"].isNotNull(), text).otherwise("")


def as_of_note(as_of: Column) -> Column:
    return F.coalesce(F.concat(F.lit(" Only filings public on or before "), F.nullif(F.trim(as_of.cast("string")), F.lit("")), F.lit(" were used.")), F.lit(""))


def numeric_text(r: dict[str, Column], as_of: Column, company: Column | None = None) -> Column:
    """Text of an answer with one figure; null if there is none."""
    who = r["ticker"] if company is None else F.coalesce(company, r["ticker"])
    return F.concat(who, F.lit("'s "), label(r["metric"]), F.lit(" for "), period(r["fiscal_label"], r["end_date"]), F.lit(" was "), fmt.with_exact(r["value"], r["unit"]), F.lit(". [1]"), restated_note(r), amendment_note(r), as_of_note(as_of))


def calculation_label(operation: Column, first: dict[str, Column], second: dict[str, Column]) -> Column:
    """What was calculated from one metric in two periods, or from two metrics in one."""
    a, b = label(first["metric"]), label(second["metric"])
    lo, hi = F.least(first["fiscal_label"], second["fiscal_label"]), F.greatest(first["fiscal_label"], second["fiscal_label"])
    span = F.when(lo < hi, F.concat(F.lit("fiscal "), lo.cast("string"), F.lit(" to "), hi.cast("string"))).otherwise(F.concat(F.lit("fiscal "), lo.cast("string")))
    two = a != b
    c = F.concat
    return (
        F.when(two & (operation == "ratio"), c(F.lit("ratio of "), a, F.lit(" to "), b, F.lit(" for "), span)).when(two & (operation == "difference"), c(a, F.lit(" less "), b, F.lit(", "), span)).when(operation == "growth_pct", c(a, F.lit(" growth, "), span))
        .when(operation == "cagr_pct", c(a, F.lit(" compound annual growth rate, "), span)).when(operation == "margin_pct", c(a, F.lit(" margin for "), span)).when(operation == "ratio", c(a, F.lit(" ratio for "), span)).when(operation == "difference", c(F.lit("change in "), a, F.lit(", "), span))
        .otherwise(c(operation, F.lit(" for "), span))
    )


def computed_text(operation: str, value: Column, first: dict[str, Column], second: dict[str, Column], as_of: Column) -> Column:
    """Text of an answer with a calculation of two figures: its label, result, formula and inputs; null without a result."""
    unit = {"growth_pct": F.lit("percent"), "margin_pct": F.lit("percent"), "ratio": F.lit("ratio")}.get(operation, first["unit"])
    one = lambda r: F.concat(period(r["fiscal_label"], r["end_date"]), F.lit(" "), label(r["metric"]), F.lit(" "), fmt.with_exact(r["value"], r["unit"]))
    return F.concat(first["ticker"], F.lit("'s "), calculation_label(F.lit(operation), first, second), F.lit(" was "), fmt.with_exact(value, unit), F.lit(". Computed as "), calc.formula(operation, first["value"], second["value"]), F.lit(" from "), one(first), F.lit("; "), one(second), F.lit(". [1] [2]"), restated_note(first), as_of_note(as_of))


def trend_text(rows: DataFrame, group: list[str], as_of: Column) -> DataFrame:
    """(group..., text): all figures of a group in order of their period with the change over the span.

    ``rows`` hold the group, ticker, metric, fiscal_label, end_date, value and unit, few rows a group.
    """
    c = F.concat
    g = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.coalesce(F.col("end_date").cast("string"), F.lit("")).alias("e"), "fiscal_label", "value", "unit", "ticker", "metric"))).alias("r"))
    first, last = F.element_at("r", 1), F.element_at("r", -1)
    line = lambda x, i: c(F.lit("- fiscal "), x.getField("fiscal_label").cast("string"), F.lit(" (ended "), x.getField("e"), F.lit("): "), fmt.with_exact(x.getField("value"), x.getField("unit")), F.lit(" ["), (i + 1).cast("string"), F.lit("]"))
    head = c(first.getField("ticker"), F.lit("'s "), label(first.getField("metric")), F.lit(", fiscal "), first.getField("fiscal_label").cast("string"), F.lit(" to "), last.getField("fiscal_label").cast("string"), F.lit(":\n"))
    delta = (last.getField("value") - first.getField("value")).cast("decimal(38,10)")
    moved = F.when(delta > 0, "rose").when(delta < 0, "fell").otherwise("was unchanged by")
    change = F.when(F.size("r") > 1, c(F.lit("\n\nOver that span it "), moved, F.lit(" "), fmt.with_exact(F.abs(delta).cast("decimal(38,10)"), first.getField("unit")), F.lit("."))).otherwise("")
    return g.select(*group, c(head, F.array_join(F.transform("r", line), "\n"), change, as_of_note(as_of)).alias("text"))


def compare_text(rows: DataFrame, group: list[str], as_of: Column) -> DataFrame:
    """(group..., text): the figures of several companies, and by how much the highest exceeds the lowest if all share a unit."""
    c = F.concat
    g = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("ticker", "fiscal_label", F.coalesce(F.col("end_date").cast("string"), F.lit("")).alias("e"), "value", "unit", "metric"))).alias("r"))
    line = lambda x, i: c(F.lit("- "), x.getField("ticker"), F.lit(": "), fmt.with_exact(x.getField("value"), x.getField("unit")), F.lit(" for "), period(x.getField("fiscal_label"), x.getField("e")), F.lit(" ["), (i + 1).cast("string"), F.lit("]"))
    by = F.sort_array(F.transform("r", lambda x: F.struct(x.getField("value").alias("value"), x.getField("ticker").alias("ticker"))))
    low, high = F.element_at(by, 1), F.element_at(by, -1)
    gap = (high.getField("value") - low.getField("value")).cast("decimal(38,10)")
    unit = F.element_at("r", 1).getField("unit")
    percent = F.when(low.getField("value") > 0, c(F.lit(", "), fmt.percent(calc.quotient(gap, low.getField("value"), 4) * 100), F.lit(" higher"))).otherwise("")
    ends = F.when(F.size(F.array_distinct(F.transform("r", lambda x: x.getField("e")))) > 1, ". Note the fiscal years end on different dates, so the periods are not identical").otherwise("")
    one_unit = F.size(F.array_distinct(F.transform("r", lambda x: F.coalesce(x.getField("unit"), F.lit(""))))) == 1
    told = F.when((F.size("r") > 1) & one_unit & (low.getField("ticker") != high.getField("ticker")), c(F.lit("\n\n"), high.getField("ticker"), F.lit(" reported "), fmt.with_exact(gap, unit), F.lit(" more than "), low.getField("ticker"), percent, ends, F.lit("."))).otherwise("")
    name = label(F.element_at("r", 1).getField("metric"))
    head = c(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1000), F.lit(", as each company reports it:\n"))
    return g.select(*group, c(head, F.array_join(F.transform("r", line), "\n"), told, as_of_note(as_of)).alias("text"))


def gold_items(resolved: DataFrame) -> DataFrame:
    """(id, category, question, value): evaluation items for one figure each, built from resolved figures."""
    ident = F.concat_ws("-", F.lit("N"), "ticker", F.upper(F.replace("metric", F.lit("_"), F.lit(""))), F.col("fiscal_label").cast("string"))
    question = F.concat(F.lit("What was "), F.col("ticker"), F.lit("'s "), label(F.col("metric")), F.lit(" in fiscal "), F.col("fiscal_label").cast("string"), F.lit("?"))
    return resolved.select(ident.alias("id"), F.lit("numeric").alias("category"), question.alias("question"), calc.plain(F.col("value")).alias("value"))


def highlighted(text: Column, number: Column) -> Column:
    """A passage with every whole occurrence of a number marked; letters that HTML reserves are written as entities."""
    safe = F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    quoted = F.regexp_replace(number, r"([.])", "\\\\.")
    return F.when(number.isNull() | (number == ""), safe).otherwise(F.regexp_replace(safe, F.concat(F.lit(r"(?<![\d.,])("), quoted, F.lit(r")(?![\d]|[.,]\d)")), F.lit("<mark>$1</mark>")))


def reply_style(text: Column, sources: int) -> Column:
    """Struct (style, cited, invented, refused, compliant) of a model's reply that may cite sources 1 to ``sources``.

    Style is ascii, fullwidth, mixed or none by the brackets of its markers; invented ones lie outside the
    sources. A reply that declines must state no number of three digits or more but years.
    """
    t = F.coalesce(text, F.lit(""))
    plain = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))
    wide = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"【(\d{1,9})】"), F.lit(1)), lambda x: x.cast("int")))
    cited = F.array_sort(F.array_union(plain, wide))
    style = F.when((F.size(plain) > 0) & (F.size(wide) > 0), "mixed").when(F.size(wide) > 0, "fullwidth").when(F.size(plain) > 0, "ascii").otherwise("none")
    invented = F.filter(cited, lambda n: (n < 1) | (n > sources))
    folded = F.translate(t, "’ʼ", "''")
    refused = folded.rlike(DECLINES)
    numbers = F.filter(F.regexp_extract_all(t, F.lit(r"(\d[\d,]{2,})"), F.lit(1)), lambda n: ~n.rlike(r"^(?:19|20)\d{2}$"))
    return F.struct(style.alias("style"), cited.alias("cited"), invented.alias("invented"), refused.alias("refused"), F.when(refused, F.size(numbers) == 0).otherwise((F.size(invented) == 0) & (style == "ascii")).alias("compliant"))


#: Auxiliaries that a refusal negates, in full and contracted.
AUXILIARIES = ("do", "does", "did", "is", "are", "was", "were", "could")
DECLINES = r"(?i)\b(?:" + "|".join([*[rf"{a}\s+not|{a}n'?t" for a in AUXILIARIES], "cannot", "can'?t", "unable", r"no\s+information", "unavailable"]) + r"|not\s+\w+)\b"


def canonical_numeral(cell: Column) -> Column:
    """One spelling of a table cell's number, null for other cells: currency, percent and separators dropped, parentheses and dashes as minus."""
    t = F.regexp_replace(F.trim(F.replace(F.coalesce(cell, F.lit("")), F.lit("\u00a0"), F.lit(" "))), r"^\$ *", "")
    paren = t.startswith("(") & t.endswith(")")
    bare = F.regexp_replace(F.translate(F.regexp_replace(t, r"^\(+|\)+$", ""), "−–—", "---"), r"[$%, ]", "")
    minus = bare.startswith("-")
    digits = F.when(minus, F.substring(bare, 2, 1000)).otherwise(bare)
    value = F.when(digits.rlike(r"^\d+(?:\.\d+)?$"), calc.plain(digits.try_cast("decimal(38,10)")))
    return F.when(value == "0", "0").otherwise(F.concat(F.when(paren | minus, "-").otherwise(""), value))


def window_around(parent: Column, chunk: Column, budget: int) -> Column:
    """At most ``budget`` characters of a section around a passage of it, with signs of omission; its head if the passage isn't found.

    The passage is looked for as a whole, then by probes of 120 and 60 characters at its start, quarter, half and
    three quarters. A section within the budget stays whole.
    """
    cut_sign = F.lit(" […] ")
    body = F.trim(chunk)
    n = F.length(body)
    tries = [F.instr(parent, body)]
    starts = [F.lit(0)]
    for length in (120, 60):
        for quarter in range(4):
            at = F.floor(n * quarter / 4).cast("int")
            probe = F.substring(body, at + 1, F.lit(length))
            tries.append(F.when(F.length(probe) >= 40, F.instr(parent, probe)).otherwise(0))
            starts.append(at)
    found = F.coalesce(*[F.when(t > 0, F.greatest(t - s, F.lit(1))) for t, s in zip(tries, starts)])

    def cut(f: Column) -> Column:
        span = F.least(n, F.lit(budget))
        start = F.greatest(f - F.floor((budget - span) / 2).cast("int"), F.lit(1))
        end = F.least(F.length(parent), start + budget - 1)
        begin = F.greatest(end - budget + 1, F.lit(1))
        return F.concat(F.when(begin > 1, cut_sign).otherwise(""), F.substring(parent, begin, F.lit(budget)), F.when(end < F.length(parent), cut_sign).otherwise(""))

    head = F.concat(F.substring(parent, 1, budget), cut_sign)
    placed = F.get(F.transform(F.array(found), lambda f: F.when(f.isNull(), head).otherwise(cut(f))), F.lit(0))
    return F.when(F.length(parent) <= budget, parent).otherwise(placed)
