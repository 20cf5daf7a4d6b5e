"""Answers: messages, verdicts on stated figures, citation numbering, entity mentions and content blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Templates of refusals; {company}, {period} and {as_of} are filled in.
MESSAGES = {
    "company_not_found": "No filer named {company} is known.", "no_filing_for_company": "{company} has no annual report on file.", "period_not_covered": "There is no report of {company} for {period}.",
    "period_not_filed_as_of": "On {as_of} the report of {company} for {period} had not been filed.", "future_period": "{period} lies in the future.", "metric_not_supported": "This figure is not among the measures that are resolved.",
    "metric_not_found_in_filing": "The report of {company} for {period} does not state this figure.", "ambiguous_concept": "{company} states several figures for {period} that disagree.", "unsupported_period_type": "Only annual periods are covered.",
    "out_of_scope": "Only questions about annual reports are answered.", "insufficient_evidence": "The reports of {company} for {period} hold too little to answer.",
}


def message(reason: Column, company: Column, period: Column, as_of: Column) -> Column:
    """Refusal text of a reason; null for an unknown one."""
    out = F.lit(None).cast("string")
    for name, text in MESSAGES.items():
        parts: list[Column] = []
        rest = text
        while "{" in rest:
            head, _, tail = rest.partition("{")
            key, _, rest = tail.partition("}")
            parts += [F.lit(head), F.coalesce({"company": company, "period": period, "as_of": as_of}[key], F.lit("?"))]
        out = F.when(reason == name, F.concat(*parts, F.lit(rest))).otherwise(out)
    return out


def renumber(text: Column) -> Column:
    """Citation markers numbered 1..n in the order of their first appearance."""
    used = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)))
    marked = F.aggregate(F.sequence(F.lit(1), F.size(used)), text, lambda acc, i: F.replace(acc, F.concat(F.lit("["), F.element_at(used, i), F.lit("]")), F.concat(F.lit("⟦"), i.cast("string"), F.lit("⟧"))))
    return F.when(F.size(used) > 0, F.translate(marked, "⟦⟧", "[]")).otherwise(text)


def phrase_key(text: Column) -> Column:
    """Lower-case words of a name without possessives, legal suffixes and a leading article."""
    t = F.regexp_replace(F.lower(text), r"['’]s\b", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}&]+", " "), " +", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^the ", ""), r"(?: (?:inc|corp|corporation|co|company|ltd|plc|llc|group|holdings))+$", ""))


def mentions(questions: DataFrame, ident: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """(ident, key, at, words): the names a question mentions, the longest at every place.

    ``names`` holds (name, key) with keys of ``phrase_key``. Word runs of a question are equi-joined with
    the dictionary, up to the length of its longest name; a match inside a longer match of the question
    is dropped.
    """
    known = names.select(F.col(name).alias("key")).filter("key <> ''").distinct()
    most_words = known.agg(F.max(F.size(F.split("key", " ")))).first()[0] or 0
    q = questions.select(F.col(ident).alias("ident"), F.split(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"['’]s\b", ""), r"[^\p{L}\p{N}&]+", " "), " +", " ")), " ").alias("w")).filter("ident is not null and w is not null")
    runs = q.select("ident", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("at")).select("ident", "at", "w", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(1, most_words)), F.size("w") - F.col("at") + 1))).alias("n"))
    grams = runs.select("ident", "at", "n", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("key"))
    met = grams.join(known, "key", "left_semi")
    ahead = F.max(F.col("at") + F.col("n")).over(Window.partitionBy("ident").orderBy("at", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    kept = met.withColumn("__until", ahead).filter(F.col("__until").isNull() | (F.col("at") + F.col("n") > F.col("__until")))
    return kept.select(F.col("ident").alias(ident), "key", "at", F.col("n").alias("words"))


def blocks(documents: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, position, kind, chars): paragraphs of a section; too short ones are dropped.

    Blank lines part paragraphs; those of table rows are tables, those under 500 characters that begin
    with a footnote mark are footnotes, all others of 30 characters or more are text.
    """
    parts = documents.select(ident, F.posexplode(F.split(text, r"\n\s*\n")).alias("position", "p")).withColumn("p", F.trim(F.regexp_replace("p", r"[ \t]+", " ")))
    kind = F.when(F.col("p").startswith("|"), "table").when(F.length("p") < 30, F.lit(None)).when((F.length("p") < 500) & F.col("p").rlike(r"^[(*†‡§¶\d]"), "footnote").otherwise("text")
    return parts.withColumn("kind", kind).filter("kind is not null").select(ident, "position", "kind", F.length("p").alias("chars"))


def smoke_verdict(expected: Column, status: Column, reason_expected: Column, reason: Column) -> Column:
    """pass, or the first of status and reason that is not as expected."""
    return F.when(~status.eqNullSafe(expected), "status").when(reason_expected.isNotNull() & ~reason.eqNullSafe(reason_expected), "reason").otherwise("pass")
