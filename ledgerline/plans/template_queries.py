"""Queries that write answers and evaluation items out of resolved figures, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fmt
from ..functions.text import iso_day
from ..operators import answers, registry, resolve
from ..runtime import table
from . import money_sql
from .book import book
from .filing_queries import THIS_YEAR, _RESOLVED, _facts, _resolved, _settled

QUERIES, SQL, query = book()
_LABEL = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{t.lower().replace(chr(39), chr(39) * 2)}'" for m, t in registry.LABELS.items()) + " END"


@query(f"SELECT id, {money_sql.money('value', 'unit')} AS money FROM facts WHERE value IS NOT NULL")
def money_format(spark, d):
    """Readable form of every number, whatever its size and unit."""
    return _facts(spark, d).filter("value is not null").select("id", fmt.money(F.col("value"), F.col("unit")).alias("money"))


@query(f"SELECT id, {money_sql.exact('value', 'unit')} AS exact FROM facts WHERE value IS NOT NULL")
def exact_format(spark, d):
    return _facts(spark, d).filter("value is not null").select("id", fmt.exact(F.col("value"), F.col("unit")).alias("exact"))


_FIG = f"""{_RESOLVED}, fg AS (SELECT r.*, f.period_end AS end_date, f.filing_date, f.form_type, value::decimal(38,10) AS v FROM resolved r JOIN f USING (accession) WHERE status = 'resolved')"""


def _columns(prefix=""):
    return {c: F.col(prefix + c) for c in answers.FIGURE}


@query(f"""{_FIG} SELECT DISTINCT request_id, ticker || '''s ' || {_LABEL} || ' for fiscal ' || fiscal_label::varchar || ' (year ended ' || end_date::varchar || ') was ' || {money_sql.with_exact('v', 'unit')} || '. [1]'
 || CASE WHEN restated THEN ' This figure is restated: it comes from ' || form_type || ' ' || accession || ', filed ' || filing_date::varchar || ', which superseded the original filing for fiscal ' || fiscal_label::varchar || '.' ELSE '' END
 || CASE WHEN NOT restated AND amendment_accession IS NOT NULL THEN ' An amendment to the fiscal ' || fiscal_label::varchar || ' filing exists (' || amendment_accession || ') but does not restate this figure.' ELSE '' END
 || CASE WHEN split_part(request_id, '/', 4) <> '' THEN ' Only filings public on or before ' || split_part(request_id, '/', 4) || ' were used.' ELSE '' END AS text FROM fg""")
def numeric_answers(spark, d):
    """The answer to every request that resolves."""
    day = F.split_part("request_id", F.lit("/"), F.lit(4))
    return _resolved(spark, d).filter("status = 'resolved'").select("request_id", answers.numeric_text(_columns(), day).alias("text"))


_YEARS = f"{_FIG}, yr AS (SELECT DISTINCT ticker, metric, fiscal_label, end_date, v, unit, accession, filing_date, form_type, restated, amendment_accession FROM fg WHERE split_part(request_id, '/', 3) = 'fiscal_label' AND split_part(request_id, '/', 4) = '')"


def _years(spark, d):
    """One resolved figure for every ticker, metric and year, without a bound of time: only requests of that form are resolved, each once."""
    rows = table(spark, d, "outcomes").filter("outcome_id is not null").select(F.upper("ticker").alias("ticker"), F.col("fiscal_label").alias("label"), iso_day(F.col("as_of")).alias("as_of"))
    asked = rows.filter("as_of is null").distinct().withColumn("kind", F.lit("fiscal_label")).withColumn("period_end", F.lit(None).cast("date"))
    return resolve.settle(asked, _settled(spark, d), THIS_YEAR).filter("status = 'resolved'").select(*answers.FIGURE).distinct()


_ONE = "('fiscal ' || {p}.fiscal_label::varchar || ' (year ended ' || {p}.end_date::varchar || ') ' || {l} || ' ' || {m})"


@query(f"""{_YEARS}, pr AS (SELECT a.ticker, a.metric, a.fiscal_label AS ya, b.fiscal_label AS yb, a.end_date AS ea, b.end_date AS eb, a.v AS va, b.v AS vb, a.unit AS ua, b.unit AS ub, a.restated AS ra, a.form_type AS fa, a.accession AS ca, a.filing_date AS da FROM yr a JOIN yr b ON a.ticker = b.ticker AND a.metric = b.metric AND a.fiscal_label = b.fiscal_label + 1 WHERE a.unit IS NOT DISTINCT FROM b.unit),
lb AS (SELECT *, {_LABEL} AS lab FROM pr)
SELECT ticker, metric, ya AS fiscal_label, ticker || '''s change in ' || lab || ', fiscal ' || least(ya, yb)::varchar || ' to ' || greatest(ya, yb)::varchar || ' was ' || {money_sql.with_exact('(va - vb)::decimal(38,10)', 'ua')} || '. Computed as ' || CASE WHEN va < 0 THEN '-' ELSE '' END || {money_sql.plain('va')} || ' - ' || CASE WHEN vb < 0 THEN '-' ELSE '' END || {money_sql.plain('vb')}
 || ' from fiscal ' || ya::varchar || ' (year ended ' || ea::varchar || ') ' || lab || ' ' || {money_sql.with_exact('va', 'ua')} || '; fiscal ' || yb::varchar || ' (year ended ' || eb::varchar || ') ' || lab || ' ' || {money_sql.with_exact('vb', 'ub')} || '. [1] [2]'
 || CASE WHEN ra THEN ' This figure is restated: it comes from ' || fa || ' ' || ca || ', filed ' || da::varchar || ', which superseded the original filing for fiscal ' || ya::varchar || '.' ELSE '' END AS text FROM lb""")
def computed_answers(spark, d):
    """The change of every ticker's figure from one year to the next, as an answer."""
    y = _years(spark, d)
    a = y.select(*[F.col(c).alias(f"a_{c}") for c in answers.FIGURE])
    b = y.select(*[F.col(c).alias(f"b_{c}") for c in answers.FIGURE])
    j = a.join(b, (F.col("a_ticker") == F.col("b_ticker")) & (F.col("a_metric") == F.col("b_metric")) & (F.col("a_fiscal_label") == F.col("b_fiscal_label") + 1) & F.col("a_unit").eqNullSafe(F.col("b_unit")))
    value = (F.col("a_value") - F.col("b_value")).cast("decimal(38,10)")
    return j.select(F.col("a_ticker").alias("ticker"), F.col("a_metric").alias("metric"), F.col("a_fiscal_label").alias("fiscal_label"), answers.computed_text("difference", value, _columns("a_"), _columns("b_"), F.lit(None).cast("string")).alias("text"))


@query(f"""{_YEARS}, o AS (SELECT *, row_number() OVER w AS k, first_value(v) OVER w AS v0, first_value(fiscal_label) OVER w AS y0, first_value(unit) OVER w AS u0, count(*) OVER (PARTITION BY ticker, metric) AS n FROM yr WINDOW w AS (PARTITION BY ticker, metric ORDER BY end_date, fiscal_label, v, unit)),
l AS (SELECT ticker, metric, max(n) AS n, any_value(v0) AS v0, any_value(y0) AS y0, any_value(u0) AS u0, arg_max(v, k) AS v1, arg_max(fiscal_label, k) AS y1, string_agg('- fiscal ' || fiscal_label::varchar || ' (ended ' || end_date::varchar || '): ' || {money_sql.with_exact('v', 'unit')} || ' [' || k::varchar || ']', chr(10) ORDER BY k) AS body FROM o GROUP BY 1, 2)
SELECT ticker, metric, ticker || '''s ' || {_LABEL} || ', fiscal ' || y0::varchar || ' to ' || y1::varchar || ':' || chr(10) || body || CASE WHEN n > 1 THEN chr(10) || chr(10) || 'Over that span it ' || CASE WHEN v1 > v0 THEN 'rose' WHEN v1 < v0 THEN 'fell' ELSE 'was unchanged by' END || ' ' || {money_sql.with_exact('abs(v1 - v0)::decimal(38,10)', 'u0')} || '.' ELSE '' END AS text FROM l""")
def trend_answers(spark, d):
    """Every ticker's figures over its years, as an answer."""
    return answers.trend_text(_years(spark, d), ["ticker", "metric"], F.lit(None).cast("string"))


@query(f"""{_YEARS}, o AS (SELECT *, row_number() OVER (PARTITION BY metric, fiscal_label ORDER BY ticker, end_date, v) AS k FROM yr),
gp AS (SELECT metric, fiscal_label, count(*) AS n, count(DISTINCT coalesce(unit, '')) AS us, count(DISTINCT end_date) AS es, arg_min(unit, k) AS u, min(v) AS lo, max(v) AS hi, min((v, ticker)) AS l, max((v, ticker)) AS h, string_agg('- ' || ticker || ': ' || {money_sql.with_exact('v', 'unit')} || ' for fiscal ' || fiscal_label::varchar || ' (year ended ' || end_date::varchar || ') [' || k::varchar || ']', chr(10) ORDER BY k) AS body FROM o GROUP BY 1, 2),
cg AS (SELECT *, {_LABEL} AS lab, (hi - lo)::decimal(38,10) AS gap FROM gp)
SELECT metric, fiscal_label, upper(lab[1]) || lab[2:] || ', as each company reports it:' || chr(10) || body || CASE WHEN n > 1 AND us = 1 AND l[2] <> h[2] THEN chr(10) || chr(10) || h[2] || ' reported ' || {money_sql.with_exact('gap', 'u')} || ' more than ' || l[2]
 || CASE WHEN lo > 0 THEN ', ' || ((replace((hi - lo)::decimal(38,10)::varchar, '.', '')::hugeint * 20000 + replace(lo::decimal(38,10)::varchar, '.', '')::hugeint) // (2 * replace(lo::decimal(38,10)::varchar, '.', '')::hugeint) / 100.0)::decimal(38,2)::varchar || '% higher' ELSE '' END
 || CASE WHEN es > 1 THEN '. Note the fiscal years end on different dates, so the periods are not identical' ELSE '' END || '.' ELSE '' END AS text FROM cg""")
def compare_answers(spark, d):
    """All tickers' figures of a year side by side, as an answer."""
    return answers.compare_text(_years(spark, d), ["metric", "fiscal_label"], F.lit(None).cast("string"))


@query(f"{_YEARS} SELECT DISTINCT 'N-' || ticker || '-' || upper(replace(metric, '_', '')) || '-' || fiscal_label::varchar AS id, 'numeric' AS category, 'What was ' || ticker || '''s ' || {_LABEL} || ' in fiscal ' || fiscal_label::varchar || '?' AS question, CASE WHEN v < 0 THEN '-' ELSE '' END || {money_sql.plain('v')} AS value FROM yr")
def built_gold(spark, d):
    """An evaluation item for every resolved figure."""
    return answers.gold_items(_years(spark, d)).distinct()


@query(r"""WITH r AS (SELECT key, coalesce(content, '') AS t, list_transform(regexp_extract_all(coalesce(content, ''), '\[(\d{1,9})\]', 1), lambda x: x::int) AS p, list_transform(regexp_extract_all(coalesce(content, ''), '【(\d{1,9})】', 1), lambda x: x::int) AS w FROM responses),
s AS (SELECT key, t, list_sort(list_distinct(list_concat(p, w))) AS c, CASE WHEN len(p) > 0 AND len(w) > 0 THEN 'mixed' WHEN len(w) > 0 THEN 'fullwidth' WHEN len(p) > 0 THEN 'ascii' ELSE 'none' END AS style, regexp_matches(translate(t, '’ʼ', ''''''), '@DECLINES') AS refused FROM r)
SELECT key, style, array_to_string(c, ',') AS cited, len(list_filter(c, lambda n: n < 1 OR n > 3)) AS invented, refused, CASE WHEN refused THEN len(list_filter(regexp_extract_all(t, '\d[\d,]{2,}'), lambda n: NOT regexp_matches(n, '^(?:19|20)\d{2}$'))) = 0 ELSE len(list_filter(c, lambda n: n < 1 OR n > 3)) = 0 AND style = 'ascii' END AS compliant FROM s""".replace("@DECLINES", answers.DECLINES.replace("'", "''")))
def reply_styles(spark, d):
    """How every reply cites three sources, and whether it declines."""
    s = answers.reply_style(F.col("content"), 3)
    return table(spark, d, "responses").select("key", s.alias("s")).select("key", "s.style", F.array_join(F.col("s.cited").cast("array<string>"), ",").alias("cited"), F.size("s.invented").alias("invented"), "s.refused", "s.compliant")


@query(r"""WITH r AS (SELECT side, companyfacts_value AS c FROM ixbrl_crosscheck WHERE companyfacts_value IS NOT NULL), t AS (SELECT DISTINCT c, regexp_replace(trim(replace(c, chr(160), ' ')), '^\$ *', '') AS t FROM r),
b AS (SELECT c, t LIKE '(%)' AS paren, regexp_replace(translate(regexp_replace(t, '^\(+|\)+$', '', 'g'), '−–—', '---'), '[$%, ]', '', 'g') AS b FROM t), g AS (SELECT c, paren OR b LIKE '-%' AS neg, CASE WHEN b LIKE '-%' THEN substr(b, 2) ELSE b END AS dg FROM b),
v AS (SELECT c, neg, CASE WHEN regexp_matches(dg, '^\d+(?:\.\d+)?$') THEN regexp_replace(regexp_replace(dg::decimal(38,10)::varchar, '(\.\d*?)0+$', '\1'), '\.$', '') END AS v FROM g)
SELECT c AS cell, CASE WHEN v = '0' THEN '0' ELSE CASE WHEN neg THEN '-' ELSE '' END || v END AS numeral FROM v""")
def cell_numerals(spark, d):
    """One spelling of every number that the other copy prints."""
    r = table(spark, d, "ixbrl_crosscheck").filter("companyfacts_value is not null").select(F.col("companyfacts_value").alias("cell")).distinct()
    return r.select("cell", answers.canonical_numeral(F.col("cell")).alias("numeral"))


@query(r"""WITH n AS (SELECT id, coalesce(min(answer), '') AS t, regexp_extract(coalesce(min(answer), ''), '(\d+(?:\.\d+)?) million', 1) AS n FROM turns GROUP BY 1) SELECT id, len(regexp_extract_all(t, '(?:^|[^\d.,])' || replace(n, '.', '\.') || '(?:[^\d.,]|[.,](?:\D|$)|$)')) AS marks FROM n WHERE n <> ''""")
def highlighted_numbers(spark, d):
    """How often the first amount in millions of every answer is marked in it."""
    t = table(spark, d, "turns").groupBy("id").agg(F.coalesce(F.min("answer"), F.lit("")).alias("t")).withColumn("n", F.regexp_extract("t", r"(\d+(?:\.\d+)?) million", 1)).filter("n <> ''")
    marked = answers.highlighted(F.col("t"), F.col("n"))
    return t.select("id", F.size(F.regexp_extract_all(marked, F.lit("(<mark>)"), F.lit(1))).alias("marks"))


@query("""WITH s AS (SELECT ticker, fiscal_year, section_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS p FROM documents WHERE ticker IS NOT NULL AND fiscal_year IS NOT NULL AND section_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT d.doc_id, s.p, trim(d.text, ' ') AS b FROM documents d JOIN s USING (ticker, fiscal_year, section_id) WHERE d.text IS NOT NULL), k AS (SELECT doc_id, p, length(p) AS lp, length(b) AS n, CASE WHEN b = '' THEN 1 ELSE instr(p, b) END AS f FROM j),
x AS (SELECT *, greatest(f - ((2000 - least(n, 2000)) // 2), 1) AS st FROM k), y AS (SELECT *, least(lp, st + 1999) AS e FROM x), z AS (SELECT *, greatest(e - 1999, 1) AS bg FROM y)
SELECT doc_id, CASE WHEN lp <= 2000 THEN md5(p) ELSE md5(CASE WHEN bg > 1 THEN ' […] ' ELSE '' END || substr(p, bg, 2000) || CASE WHEN e < lp THEN ' […] ' ELSE '' END) END AS hash FROM z""")
def context_windows(spark, d):
    """Every passage with 2,000 characters of its section around it, as a hash of the text."""
    from ..operators.retrieval import section_texts

    docs = table(spark, d, "documents").filter("ticker is not null and fiscal_year is not null and section_id is not null and text is not null")
    keys = ["ticker", "fiscal_year", "section_id"]
    parents = section_texts(docs, docs.select(*keys), keys, docs.count()).withColumnRenamed("text", "parent")
    return docs.join(parents, keys).select("doc_id", F.md5(answers.window_around(F.col("parent"), F.col("text"), 2000)).alias("hash"))
