"""Queries over events, source formats and heading candidates, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import transforms
from ..operators import headings, sections
from ..runtime import table
from ..sources import inline
from ..streaming import limits

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
walk AS (SELECT event_id, user_id, n, true AS admitted, 0 AS retry_after, NULL::double AS a, t AS b FROM e WHERE n = 1 UNION ALL
SELECT e.event_id, e.user_id, e.n, k.ok, CASE WHEN k.ok THEN 0 ELSE greatest(1, trunc(3600 - (e.t - walk.a))::int + 1) END, CASE WHEN k.ok THEN walk.b ELSE walk.a END, CASE WHEN k.ok THEN e.t ELSE walk.b END
FROM walk JOIN e ON e.user_id = walk.user_id AND e.n = walk.n + 1, LATERAL (SELECT walk.a IS NULL OR e.t - walk.a >= 3600 AS ok) k) SELECT event_id, user_id, admitted, retry_after FROM walk""")
def rate_limit_sliding(spark, d):
    return limits.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", 3600, 2)


@query("""SELECT event_id, count(*) OVER w AS used, round(sum(value) OVER w, 4) AS spent FROM (SELECT *, epoch_us(ts) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)""")
def budget_window(spark, d):
    used = limits.budget_use(table(spark, d, "events"), "user_id", "ts", "value", 86400)
    return used.select("event_id", "used", F.round("spent", 4).alias("spent"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, d):
    t = limits.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value")
    return t.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, d):
    s = limits.sessions(table(spark, d, "events").filter("user_id is not null"), "user_id", "ts", "30 minutes")
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_valid(props) AS valid FROM events")
def schema_projection(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("SELECT id, value::varchar AS value, coalesce(unit, '?') AS unit, end_date FROM facts WHERE value IS NOT NULL AND unit IS NOT NULL AND end_date IS NOT NULL")
def inline_roundtrip(spark, d):
    """Every numeric fact printed as an inline-tagged document and read back."""
    f = table(spark, d, "facts").filter("value is not null and unit is not null and end_date is not null")
    tag = F.concat(
        F.lit('<xbrli:context id="c"><xbrli:period><xbrli:instant>'), F.col("end_date").cast("string"), F.lit('</xbrli:instant></xbrli:period></xbrli:context><xbrli:unit id="u"><xbrli:measure>x:'), F.col("unit"), F.lit('</xbrli:measure></xbrli:unit><p><ix:nonFraction name="a" contextRef="c" unitRef="u" format="ixt:num-dot-decimal"'),
        F.when(F.col("value") < 0, ' sign="-"').otherwise(""), F.lit(">"), F.abs("value").cast("string"), F.lit("</ix:nonFraction></p>"),
    )
    read = inline.scan_facts(f.select("id", tag.alias("html")), "id", "html")
    return read.select(F.col("doc").cast("bigint").alias("id"), F.col("value").cast("string").alias("value"), "unit", "end_date")


@query()
def section_assign(spark, d):
    """Headings of each ticker and year chosen among its passages' sections by the heaviest increasing chain."""
    docs = table(spark, d, "documents").filter("ticker is not null and fiscal_year is not null and section_id is not null")
    cand = docs.select(F.concat_ws("/", "ticker", F.col("fiscal_year").cast("string")).alias("doc"), F.col("doc_id").alias("line_no"), F.ascii(F.substring(F.regexp_extract("section_id", r"(\d)", 1), 1, 1)).alias("priority"), F.col("section_id").alias("section"), F.least(F.col("n_chars") / 100, F.lit(20)).alias("weight"))
    return sections.assign(cand, "doc")


_DAYS = "strftime(end_date, '%B ') || day(end_date)::varchar || ', ' || year(end_date)::varchar"


@query(f"""WITH f AS (SELECT id, end_date, value_text, ['ixt:date-monthname-day-year-en', 'ixt:date-month-day-year', 'ixt:date-year-month', 'ixt:fixed-true', 'ixt:booleanfalse', 'ixt-sec:boolballotbox', 'ixt-sec:exchnameen', 'ixt:datemonthdayyear'] AS fs FROM facts WHERE end_date IS NOT NULL),
x AS (SELECT id, end_date, value_text, unnest(fs) AS format FROM f)
SELECT id, format, CASE WHEN format LIKE '%monthname%' OR format LIKE '%date-month-day%' THEN strftime(end_date, '%Y-%m-%d') WHEN format LIKE '%year-month' THEN strftime(end_date, '%Y-%m') WHEN format LIKE '%true' THEN 'true' WHEN format LIKE '%false' THEN 'false' WHEN format LIKE '%ballot%' THEN CASE WHEN value_text IS NOT NULL THEN 'true' ELSE 'false' END
  WHEN format LIKE '%exch%' THEN nullif(trim(value_text), '') ELSE 'no date' END AS value, format = 'ixt:datemonthdayyear' AS failed FROM x""")
def text_transforms(spark, d):
    """Every fact's day printed in each tagged format and read back; what a format can't read is kept."""
    f = table(spark, d, "facts").filter("end_date is not null").select("id", "end_date", "value_text")
    shown = {
        "ixt:date-monthname-day-year-en": F.concat(F.date_format("end_date", "MMMM"), F.lit("\u00a0"), F.date_format("end_date", "d"), F.lit(", "), F.date_format("end_date", "yyyy")), "ixt:date-month-day-year": F.date_format("end_date", "M/d/yy"), "ixt:date-year-month": F.date_format("end_date", "yyyy-MM"), "ixt:fixed-true": F.lit("x"), "ixt:booleanfalse": F.lit(""),
        "ixt-sec:boolballotbox": F.when(F.col("value_text").isNotNull(), "\u2612").otherwise("\u2610"), "ixt-sec:exchnameen": F.col("value_text"), "ixt:datemonthdayyear": F.lit(" no date "),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("format"), v.alias("text")) for k, v in shown.items()])
    x = f.select("id", F.explode(pairs).alias("p"))
    return x.select("id", "p.format", transforms.tagged_text(F.col("p.format"), F.col("p.text")).alias("t")).select("id", "format", "t.value", "t.failed")


_HEAD = {"item_1_business": "Item 1. Business", "item_1a_risk_factors": "Item 1A. Risk Factors", "item_3_legal": "Item 3. Legal Proceedings", "item_7_mda": "Item 7. Management's Discussion", "item_7a_market_risk": "Item 7A. Quantitative Disclosures", "item_8_financials": "Item 8. Financial Statements", "item_9a_controls": "Item 9A. Controls and Procedures"}
_ORD = ", ".join(f"('{s}', {i})" for i, s in enumerate(_HEAD))


@query(rf"""WITH o(section, n) AS (VALUES {_ORD}), d AS (SELECT doc_id, section_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1:15] AS ls FROM documents WHERE text IS NOT NULL AND section_id LIKE 'item_%'),
p AS (SELECT doc_id, section_id, list_bool_or(list_transform(ls, lambda x: length(x) >= 200 AND NOT regexp_matches(x, '(?i)incorporated\s+(?:herein\s+)?by\s+reference|^\s*refer\s+to|on\s+pages?\s+\d|pages?\s+\d+\s*[–—-]\s*\d'))) AS prose FROM d)
SELECT p.doc_id, o.section, coalesce(prose, false) AND o.section = p.section_id AS prose FROM p JOIN o me ON me.section = p.section_id JOIN o ON o.n <= me.n OR NOT coalesce(prose, false)""")
def heading_sections(spark, d):
    """Every passage behind a page of contents and its own heading: which headings are chosen, and which one has prose."""
    docs = table(spark, d, "documents").filter("text is not null and section_id like 'item_%'")
    heads = F.create_map(*[F.lit(x) for p in _HEAD.items() for x in p])
    contents = "\n".join(f"{h} {7 + 11 * i}" for i, h in enumerate(_HEAD.values()))
    page = docs.select("doc_id", F.concat(F.lit(contents + "\n\n"), F.element_at(heads, F.col("section_id")), F.lit("\n\n"), "text", F.lit("\n" * 40)).alias("page"))
    return headings.filing_sections(page, "doc_id", "page").select("doc_id", "section", "prose")
