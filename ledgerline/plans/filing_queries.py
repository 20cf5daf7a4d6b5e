"""Queries over filings and facts with their DuckDB statements, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calc
from ..functions.text import iso_day
from ..operators import catalog, facts, registry, resolve
from ..runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
DAY = "2020-06-30"
THIS_YEAR = 2026


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _filings(spark: SparkSession, d: str) -> DataFrame:
    return catalog.unique_filings(table(spark, d, "filings").drop("exhibit_docs"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "facts")


_F = "f AS (SELECT accession, max(ticker) AS ticker, max(cik) AS cik, max(form_type) AS form_type, max(period_end) AS period_end, max(fiscal_label) AS fiscal_label, max(filing_date) AS filing_date, max(primary_doc) AS primary_doc, max(collection_name) AS collection_name, max(facts_built_at) AS facts_built_at, max(amends) AS amends, max(entity_name) AS entity_name, max(fiscal_label_source) AS fiscal_label_source FROM filings GROUP BY accession)"


@query(f"WITH {_F} SELECT accession, ticker, filing_date FROM f WHERE filing_date <= DATE '{DAY}'")
def catalog_eligible(spark, d):
    return catalog.eligible(_filings(spark, d), DAY).select("accession", "ticker", "filing_date")


@query(f"WITH {_F} SELECT ticker, accession, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC, filing_date DESC, accession DESC) AS position FROM f")
def catalog_order(spark, d):
    return catalog.newest_first(_filings(spark, d)).select("ticker", "accession", "position")


@query("SELECT DISTINCT ticker, fiscal_label FROM filings")
def catalog_labels(spark, d):
    return table(spark, d, "filings").select("ticker", "fiscal_label").distinct()


_SELECT = """WITH {f}, o AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY period_end DESC, filing_date DESC, accession DESC) AS r FROM f WHERE upper(form_type) NOT LIKE '%/A'),
k AS (SELECT accession, ticker, {c} FROM o WHERE r <= 3)
SELECT accession FROM k UNION ALL SELECT accession FROM f WHERE upper(form_type) LIKE '%/A' AND (ticker, {c}) IN (SELECT ticker, {c} FROM k)"""


@query(_SELECT.format(f=_F, c="fiscal_label"))
def ingest_selection(spark, d):
    return catalog.filings_to_ingest(_filings(spark, d), 3, "fiscal_label").select("accession")


@query(_SELECT.format(f=_F, c="period_end"))
def facts_build_selection(spark, d):
    return catalog.filings_to_ingest(_filings(spark, d), 3, "period_end").select("accession")


_LINK = f"""WITH {_F}, o AS (SELECT ticker, period_end, arg_min(accession, (filing_date, accession)) AS amends FROM f WHERE upper(form_type) NOT LIKE '%/A' GROUP BY 1, 2)
SELECT f.accession, o.amends FROM f LEFT JOIN o USING (ticker, period_end) WHERE upper(form_type) LIKE '%/A'"""


@query(_LINK)
def amendment_link(spark, d):
    return catalog.link_amendments(_filings(spark, d))


_OWN = f"""{_F}, c AS (SELECT DISTINCT collection_name FROM filings WHERE collection_name IS NOT NULL),
n AS (SELECT collection_name, upper(regexp_extract(collection_name, '^([A-Za-z.]+)_(\\d{{4}})$', 1)) AS ticker, try_cast(regexp_extract(collection_name, '^([A-Za-z.]+)_(\\d{{4}})$', 2) AS int) AS fiscal_label FROM c),
o AS (SELECT ticker, fiscal_label, arg_min(accession, (filing_date, accession)) AS accession FROM f WHERE upper(form_type) NOT LIKE '%/A' GROUP BY 1, 2),
own AS (SELECT n.collection_name, o.accession FROM n LEFT JOIN o USING (ticker, fiscal_label))"""


def _collections(spark, d):
    return table(spark, d, "filings").select("collection_name").filter("collection_name is not null").distinct()


@query(f"WITH {_OWN} SELECT * FROM own")
def collection_assign(spark, d):
    return catalog.collection_owner(_filings(spark, d), _collections(spark, d))


@query(f"""WITH {_OWN}, h AS (SELECT own.accession, bool_or(coalesce(f.collection_name = own.collection_name, false)) AS same FROM own LEFT JOIN f ON f.accession = own.accession AND f.collection_name IS NOT NULL WHERE own.accession IS NOT NULL GROUP BY 1),
g AS (SELECT DISTINCT accession FROM f WHERE upper(form_type) NOT LIKE '%/A'),
k AS (SELECT CASE WHEN h.same IS NULL THEN CASE WHEN accession IN (SELECT accession FROM f WHERE collection_name IS NOT NULL) THEN 'cleared' ELSE 'unindexed' END WHEN h.same THEN 'already' ELSE 'linked' END AS kind FROM g FULL JOIN h USING (accession) UNION ALL SELECT 'orphan' FROM own WHERE accession IS NULL)
SELECT kind, count(*) AS n FROM k GROUP BY 1""")
def collection_link_report(spark, d):
    return catalog.link_report(_filings(spark, d), _collections(spark, d))


@query(f"""WITH {_F}, r AS (SELECT DISTINCT outcome_id AS request_id, ticker, fiscal_label, try_cast(nullif(regexp_extract(trim(as_of), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})([T ].*)?$', 1), '') AS date) AS as_of FROM outcomes)
SELECT r.request_id, arg_max(f.accession, (f.fiscal_label, f.filing_date, f.accession)) AS accession, max(f.fiscal_label) AS fiscal_label
FROM r JOIN f ON upper(r.ticker) = upper(f.ticker) AND (r.as_of IS NULL OR f.filing_date <= r.as_of) AND (r.fiscal_label IS NULL OR r.fiscal_label = f.fiscal_label) GROUP BY 1""")
def asof_period(spark, d):
    asked = table(spark, d, "outcomes").select(F.col("outcome_id").alias("request_id"), "ticker", "fiscal_label", iso_day(F.col("as_of")).alias("as_of")).distinct()
    return catalog.resolve_period(_filings(spark, d), asked)


@query("SELECT count(DISTINCT accession) AS filings, count(DISTINCT CASE WHEN upper(form_type) LIKE '%/A' THEN accession END) AS amendments, count(DISTINCT ticker) AS tickers, count(DISTINCT collection_name) AS collections FROM filings")
def catalog_stats(spark, d):
    return catalog.catalog_stats(table(spark, d, "filings"))


@query(f"""WITH {_F}, s AS (SELECT accession, ticker, fiscal_label, collection_name FROM f WHERE filing_date < DATE '{DAY}'),
n AS (SELECT accession, lower(ticker) AS ticker, fiscal_label + 1 AS fiscal_label, 'new' AS collection_name FROM f WHERE filing_date >= DATE '2019-06-30')
SELECT coalesce(n.accession, s.accession) AS accession, CASE WHEN n.accession IS NOT NULL THEN n.ticker ELSE s.ticker END AS ticker, CASE WHEN n.accession IS NOT NULL THEN n.fiscal_label ELSE s.fiscal_label END AS fiscal_label,
 coalesce(s.collection_name, CASE WHEN s.accession IS NULL THEN n.collection_name END) AS collection_name FROM s FULL JOIN n USING (accession)""")
def catalog_upsert(spark, d):
    f = _filings(spark, d).select("accession", "ticker", "fiscal_label", "collection_name", "filing_date")
    new = f.filter(F.col("filing_date") >= F.lit("2019-06-30").cast("date")).select("accession", F.lower("ticker").alias("ticker"), (F.col("fiscal_label") + 1).alias("fiscal_label"), F.lit("new").alias("collection_name"))
    return catalog.upsert(f.filter(F.col("filing_date") < F.lit(DAY).cast("date")).drop("filing_date"), new, "accession", ["collection_name"])


@query("SELECT count(*) AS facts, count(DISTINCT concept) AS concepts, count(DISTINCT accession) AS submissions, count(DISTINCT ticker) AS tickers FROM facts")
def facts_stats(spark, d):
    return facts.stats(_facts(spark, d))


@query("SELECT id, ticker, concept, end_date, value FROM facts WHERE concept IN ('Assets', 'us-gaap:Assets', 'Liabilities') AND period_type = 'instant' AND ticker = 'UMBT'".replace("value FROM", "value::varchar AS value FROM"))
def facts_query(spark, d):
    return facts.query(_facts(spark, d), "UMBT", ["Assets", "us-gaap:Assets", "Liabilities"], period_type="instant").select("id", "ticker", "concept", "end_date", F.col("value").cast("string").alias("value"))


@query(f"WITH {_F} SELECT accession FROM f WHERE accession IN (SELECT accession FROM facts)")
def filings_with_facts(spark, d):
    return facts.with_facts(_filings(spark, d), _facts(spark, d)).select("accession")


_ANNUAL = """e AS (SELECT accession, max(period_end) AS period_end FROM filings GROUP BY 1),
annual AS (SELECT facts.* FROM facts JOIN e USING (accession) WHERE value IS NOT NULL AND abs(date_diff('day', period_end, end_date)) <= 3 AND (period_type = 'instant' OR date_diff('day', start_date, end_date) BETWEEN 350 AND 380))"""


@query(f"WITH {_ANNUAL} SELECT id FROM annual")
def annual_facts(spark, d):
    return facts.annual(_facts(spark, d), table(spark, d, "filings")).select("id")


_RANK = "CASE WHEN upper(trim(decimals)) = 'INF' THEN 10000 ELSE try_cast(nullif(trim(decimals), '') AS int) END"
_PRECISE = f"""r AS (SELECT *, {_RANK} AS rank FROM facts WHERE value IS NOT NULL),
h AS (SELECT *, CASE WHEN rank >= 10 THEN 0::decimal(38,10) ELSE try_cast('5E' || (-(rank + 1))::varchar AS decimal(38,10)) END AS half FROM r),
b AS (SELECT *, first_value(id) OVER w AS bid, first_value(value) OVER w AS bv, first_value(half) OVER w AS bh FROM h WINDOW w AS (PARTITION BY accession, concept, context_id, unit ORDER BY rank DESC NULLS LAST, element_id NULLS FIRST, source_doc NULLS FIRST, value, id))"""


@query(f"WITH {_PRECISE} SELECT id FROM b WHERE id = bid OR NOT (value = bv OR coalesce(abs(value - bv) <= half + bh, false))")
def precision_dedupe(spark, d):
    return facts.prefer_precise(facts.numeric(_facts(spark, d))).select("id")


_HASHED = """hr AS (SELECT accession, sha256(concat_ws(chr(31), coalesce(concept, ''), coalesce(value::varchar, ''), coalesce(value_text, ''), coalesce(unit, ''), coalesce(end_date::varchar, ''))) AS r FROM facts),
hb AS (SELECT accession, substr(r, 1, 4) AS b, count(*) AS n, sha256(string_agg(r, chr(30) ORDER BY r)) AS h FROM hr GROUP BY 1, 2), hashed AS (SELECT accession, sum(n)::bigint AS facts, sha256(string_agg(b || h, chr(30) ORDER BY b || h)) AS hash FROM hb GROUP BY 1)"""


@query(f"WITH {_HASHED} SELECT * FROM hashed")
def facts_hash(spark, d):
    return facts.content_hash(_facts(spark, d), ["concept", "value", "value_text", "unit", "end_date"])


@query(f"""WITH {_HASHED}, hl AS (SELECT accession, sha256(concat_ws(chr(31), coalesce(concept, ''), coalesce(value::varchar, ''), coalesce(value_text, ''), coalesce(unit, ''), coalesce(end_date::varchar, ''))) AS r FROM facts WHERE accession NOT IN (SELECT accession FROM filings WHERE fiscal_label > 2021) AND (period_type = 'instant' OR accession IN (SELECT accession FROM filings WHERE fiscal_label <= 2015))),
lb AS (SELECT accession, substr(r, 1, 4) AS b, sha256(string_agg(r, chr(30) ORDER BY r)) AS h FROM hl GROUP BY 1, 2), was AS (SELECT accession, sha256(string_agg(b || h, chr(30) ORDER BY b || h)) AS hash FROM lb GROUP BY 1)
SELECT hashed.accession, CASE WHEN was.hash IS NULL THEN 'new' WHEN was.hash = hashed.hash THEN 'unchanged' ELSE 'built' END AS state FROM hashed LEFT JOIN was USING (accession)""")
def facts_needs_build(spark, d):
    """What a build has to do for a store that lacks late filings and the durations of all but early ones."""
    fields = ["concept", "value", "value_text", "unit", "end_date"]
    f, g = _facts(spark, d), table(spark, d, "filings")
    late, early = g.filter("fiscal_label > 2021").select("accession"), g.filter("fiscal_label <= 2015").select("accession").distinct().withColumn("early", F.lit(True))
    stored = f.join(late, "accession", "left_anti").join(early, "accession", "left").filter("period_type = 'instant' or early")
    return facts.needs_build(facts.content_hash(stored, fields), facts.content_hash(f, fields))


@query("""SELECT id, accession FROM facts WHERE accession NOT IN (SELECT accession FROM filings WHERE upper(form_type) LIKE '%/A') UNION ALL
SELECT -id AS id, accession FROM facts WHERE accession IN (SELECT accession FROM filings WHERE upper(form_type) LIKE '%/A') AND value IS NOT NULL""")
def facts_replace(spark, d):
    all_facts = _facts(spark, d).select("id", "accession", "value")
    amended = table(spark, d, "filings").filter(catalog.is_amendment(F.col("form_type"))).select("accession")
    fresh = all_facts.join(amended, "accession", "left_semi")
    kept = catalog.replace_rows(all_facts.select("id", "accession"), fresh.select("id", "accession"), ["accession"])
    return kept.join(fresh.select("id", "value"), "id", "left").join(amended.distinct().withColumn("a", F.lit(1)), "accession", "left").filter("a is null or value is not null").select(F.when(F.col("a").isNull(), F.col("id")).otherwise(-F.col("id")).alias("id"), "accession")


_REV = ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "InterestAndDividendIncomeOperating")


@query(f"""WITH o AS (SELECT accession, trim(regexp_replace(concept, '^.*:', '')) AS concept, value FROM facts WHERE value IS NOT NULL),
g AS (SELECT accession, count(DISTINCT concept) AS concepts, count(DISTINCT value) AS distinct_values, string_agg(DISTINCT concept, ',' ORDER BY concept) AS names FROM o WHERE concept IN {_REV} GROUP BY 1)
SELECT *, concepts > 1 AND distinct_values > 1 AS ambiguous FROM g""")
def revenue_ambiguity(spark, d):
    return facts.ambiguous_concepts(_facts(spark, d), list(_REV))


_ENTITY = ", ".join(f"arg_min(coalesce(value_text, CASE WHEN value IS NOT NULL THEN trunc(value)::bigint::varchar END), id) FILTER (WHERE concept = '{c}' AND (value IS NOT NULL OR value_text IS NOT NULL)) AS \"{c}\"" for c in facts.ENTITY_CONCEPTS)


@query(f"WITH o AS (SELECT id, accession, trim(regexp_replace(concept, '^.*:', '')) AS concept, value, value_text FROM facts) SELECT accession, {_ENTITY} FROM o WHERE concept IN {facts.ENTITY_CONCEPTS} AND (value IS NOT NULL OR value_text IS NOT NULL) GROUP BY 1")
def entity_map(spark, d):
    return facts.entity_map(_facts(spark, d))


@query("SELECT scale_raw, sign_raw, CASE WHEN value IS NOT NULL THEN 'numeric' WHEN value_text IS NOT NULL THEN 'text' ELSE 'nil' END AS kind, count(*) AS n FROM facts GROUP BY 1, 2, 3")
def scale_survey(spark, d):
    return facts.scale_survey(_facts(spark, d))


@query(f"""WITH {_F}, o AS (SELECT accession, arg_min(value_text, id) AS t FROM facts WHERE trim(regexp_replace(concept, '^.*:', '')) = 'DocumentPeriodEndDate' AND value_text IS NOT NULL GROUP BY 1)
SELECT f.accession, CASE WHEN o.t IS NULL THEN 'no_dei_label' WHEN try_cast(trim(o.t) AS date) IS NULL THEN 'unparsable' WHEN year(try_cast(trim(o.t) AS date)) = f.fiscal_label THEN 'match' ELSE 'mismatch' END AS verdict, f.fiscal_label = year(f.period_end) AS from_period FROM f LEFT JOIN o USING (accession)""")
def label_check(spark, d):
    """Each filing's label against the year of the period end that it states itself, and against its listed period."""
    said = facts.entity_map(_facts(spark, d)).select("accession", F.col("DocumentPeriodEndDate").alias("said"))
    f = _filings(spark, d)
    v = catalog.label_verdict(F.col("fiscal_label"), F.col("said"))
    return f.join(said, "accession", "left").select("accession", v.alias("verdict"), (F.col("fiscal_label") == F.year("period_end")).alias("from_period"))


def _requests(spark, d):
    """Every kind of period for each outcome; its period's end is that of the filer's year. Each stands for all metrics of the registry."""
    rows = table(spark, d, "outcomes").select("outcome_id", F.upper("ticker").alias("ticker"), F.col("fiscal_label").alias("asked"), iso_day(F.col("as_of")).alias("as_of")).distinct()
    ends = table(spark, d, "filings").groupBy(F.upper("ticker").alias("ticker"), F.col("fiscal_label").alias("asked")).agg(F.max("period_end").alias("__end"))
    asked = rows.join(ends, ["ticker", "asked"], "left")
    asked = asked.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in ("fiscal_label", "calendar_year", "period_end", "latest")])))
    label = F.when(F.col("kind").isin("fiscal_label", "calendar_year"), F.col("asked"))
    return asked.select("outcome_id", "ticker", "asked", "kind", label.alias("label"), F.when(F.col("kind") == "period_end", F.col("__end")).alias("period_end"), "as_of")


def _settled(spark, d, statements=None):
    filings = table(spark, d, "filings")
    return resolve.settled_filings(filings, facts.annual(_facts(spark, d), filings), statements)


def _resolved(spark, d, statements=None, metrics=resolve.METRICS):
    """A row for every request and metric; ``request_id`` names both, so no two resolved rows share one."""
    ident = F.concat_ws("/", F.col("outcome_id").cast("string"), "metric", "kind", F.coalesce(F.col("as_of").cast("string"), F.lit("")), F.coalesce(F.col("asked").cast("string"), F.lit("")), F.coalesce("ticker", F.lit("")))
    return resolve.settle(_requests(spark, d), _settled(spark, d, statements), THIS_YEAR, metrics).withColumn("request_id", ident)


_CANDS = ", ".join(f"('{m}', '{p}', '{s}', {i}, '{c}')" for m, (p, _, ss, _) in registry.METRICS.items() for s, ts in ss.items() for i, t in enumerate(ts, 1) for c in t)
_KINDS = "('fiscal_label'), ('calendar_year'), ('period_end'), ('latest')"
_RESOLVED = f"""WITH {_F}, {_ANNUAL}, cand(metric, period_type, sector, tier, concept) AS (VALUES {_CANDS}),
ends AS (SELECT upper(ticker) AS ticker, fiscal_label, max(period_end) AS e FROM filings GROUP BY 1, 2),
q AS (SELECT DISTINCT outcome_id, upper(ticker) AS ticker, fiscal_label AS label, try_cast(nullif(regexp_extract(trim(as_of), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})([T ].*)?$', 1), '') AS date) AS as_of FROM outcomes),
s AS (SELECT DISTINCT q.ticker, kind, CASE WHEN kind IN ('fiscal_label', 'calendar_year') THEN label END AS label, CASE WHEN kind = 'period_end' THEN ends.e END AS pend, coalesce(as_of, DATE '9999-12-31') AS day, q.label AS asked, q.as_of
  FROM q LEFT JOIN ends ON ends.ticker = q.ticker AND ends.fiscal_label = q.label, (VALUES {_KINDS}) k(kind)),
sh AS (SELECT *, row_number() OVER () AS sid FROM s),
st AS (SELECT accession, trim(regexp_replace(concept, '^.*:', '')) AS concept, value, unit, period_type, scale_raw FROM annual),
t AS (SELECT st.accession, cand.metric, cand.tier, count(DISTINCT st.value) AS vals, count(DISTINCT st.concept) AS concepts, min((st.concept, st.value, st.unit)) AS pick FROM st JOIN cand ON cand.sector = 'default' AND st.concept = cand.concept AND st.period_type = cand.period_type GROUP BY 1, 2, 3),
dec AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY accession, metric ORDER BY tier) = 1),
m AS (SELECT sh.sid, f.accession, f.period_end AS f_end, f.filing_date, f.fiscal_label, upper(f.form_type) LIKE '%/A' AS amended, f.filing_date <= sh.day AS public FROM sh JOIN f ON upper(f.ticker) = sh.ticker
  AND CASE kind WHEN 'fiscal_label' THEN f.fiscal_label = sh.label WHEN 'calendar_year' THEN year(f.period_end) = sh.label WHEN 'period_end' THEN f.period_end = sh.pend ELSE true END),
g AS (SELECT sid, count(*) AS n, count(*) FILTER (WHERE public) AS n_public, max(f_end) FILTER (WHERE public) AS newest FROM m GROUP BY 1),
el AS (SELECT m.* FROM m JOIN g USING (sid) WHERE public AND f_end = newest),
cov AS (SELECT sid, bool_or(accession IN (SELECT accession FROM st)) AS covered, arg_max(accession, (filing_date, accession)) FILTER (WHERE amended) AS amendment, arg_min(accession, (filing_date, accession)) AS oldest FROM el GROUP BY 1),
won AS (SELECT el.sid, dec.metric, arg_max((el.accession, el.amended, el.fiscal_label, dec.pick, dec.concepts, dec.tier), (el.filing_date, el.accession)) AS w FROM el JOIN dec USING (accession) WHERE dec.vals = 1 GROUP BY 1, 2),
x AS (SELECT q.outcome_id, mt.metric, sh.kind, sh.asked, sh.as_of, q.ticker, CASE WHEN q.ticker IS NULL OR q.ticker NOT IN (SELECT upper(ticker) FROM f) THEN 'company_not_found' WHEN g.n IS NULL AND sh.kind IN ('fiscal_label', 'calendar_year') AND sh.label > {THIS_YEAR} THEN 'future_period' WHEN g.n IS NULL THEN 'period_not_covered'
    WHEN g.n_public = 0 THEN 'period_not_filed_as_of' WHEN NOT cov.covered THEN 'period_not_covered' WHEN won.w IS NULL THEN CASE WHEN od.vals > 1 THEN 'ambiguous_concept' ELSE 'metric_not_found_in_filing' END END AS reason, won.w, cov.amendment
  FROM q JOIN sh ON sh.ticker IS NOT DISTINCT FROM q.ticker AND sh.asked IS NOT DISTINCT FROM q.label AND sh.as_of IS NOT DISTINCT FROM q.as_of CROSS JOIN (SELECT DISTINCT metric FROM cand) mt
    LEFT JOIN g USING (sid) LEFT JOIN cov USING (sid) LEFT JOIN won ON won.sid = sh.sid AND won.metric = mt.metric LEFT JOIN dec od ON od.accession = cov.oldest AND od.metric = mt.metric),
resolved AS (SELECT concat_ws('/', outcome_id::varchar, metric, kind, coalesce(as_of::varchar, ''), coalesce(asked::varchar, ''), coalesce(ticker, '')) AS request_id, metric, ticker, CASE WHEN reason IS NULL THEN 'resolved' ELSE 'abstained' END AS status, reason, CASE WHEN reason IS NULL THEN w[4][2]::varchar END AS value, CASE WHEN reason IS NULL THEN w[4][3] END AS unit, CASE WHEN reason IS NULL THEN w[4][1] END AS concept,
  CASE WHEN reason IS NULL THEN CASE WHEN w[5] = 1 THEN 'single_candidate' ELSE 'candidates_agree' END || CASE WHEN w[6] > 1 THEN '_tier' || w[6]::varchar ELSE '' END END AS rule,
  CASE WHEN reason IS NULL THEN w[1] END AS accession, CASE WHEN reason IS NULL THEN w[2] END AS restated, CASE WHEN reason IS NULL AND amendment IS DISTINCT FROM w[1] THEN amendment END AS amendment_accession, CASE WHEN reason IS NULL THEN w[3] END AS fiscal_label FROM x)"""


@query(f"{_RESOLVED} SELECT request_id, status, reason, value, unit, concept, rule, accession, restated, amendment_accession FROM resolved")
def resolve_requests(spark, d):
    """All metrics by all four kinds of period for every outcome."""
    return _resolved(spark, d).select("request_id", "status", "reason", F.col("value").cast("string").alias("value"), "unit", "concept", "rule", "accession", "restated", "amendment_accession")


@query(f"""{_RESOLVED}, sc AS (SELECT accession, trim(regexp_replace(concept, '^.*:', '')) AS concept, value::varchar AS value, min(coalesce(scale_raw, '')) AS s FROM annual GROUP BY 1, 2, 3),
tx AS (SELECT upper(ticker) AS ticker, fiscal_year AS fiscal_label, regexp_replace(string_agg(text, chr(10) ORDER BY doc_id), '[\\s ]+', ' ', 'g') AS t FROM documents WHERE section_id = 'item_8_financials' AND ticker IS NOT NULL AND fiscal_year IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
v AS (SELECT r.request_id, r.status, abs(r.value::decimal(38,10)) / power(10, coalesce(try_cast(nullif(trim(sc.s), '') AS int), 0)) AS shown, tx.t FROM resolved r LEFT JOIN sc ON sc.accession = r.accession AND sc.concept = r.concept AND sc.value = r.value LEFT JOIN tx ON tx.ticker = r.ticker AND tx.fiscal_label = r.fiscal_label),
w AS (SELECT request_id, status, t, regexp_replace(regexp_replace(shown::decimal(38,10)::varchar, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS p FROM v)
SELECT request_id, CASE WHEN status = 'resolved' THEN CASE WHEN t IS NULL THEN 'unvalidated' WHEN contains(t, p) OR contains(t, format('{{:,}}', split_part(p, '.', 1)::bigint) || CASE WHEN p LIKE '%.%' THEN '.' || split_part(p, '.', 2) ELSE '' END) THEN 'validated'
  WHEN len(regexp_extract_all(t, '\\d{{1,3}}(?:,\\d{{3}})+|\\d{{4,}}')) < 20 THEN 'unvalidated' ELSE 'conflict' END END AS validation_status FROM w""")
def resolve_validation(spark, d):
    """Whether each resolved figure is printed in its filing's financial section."""
    docs = table(spark, d, "documents").filter("section_id = 'item_8_financials' and ticker is not null and fiscal_year is not null and text is not null")
    text = docs.groupBy(F.upper("ticker").alias("ticker"), F.col("fiscal_year").alias("fiscal_label")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x.getField("text")), "\n").alias("text"))
    kinds = text.withColumn("statement", F.explode(F.array(*[F.lit(k) for k in registry.STATEMENTS])))
    return _resolved(spark, d, kinds).select("request_id", "validation_status")


@query(f"{_RESOLVED} SELECT status, coalesce(reason, '') AS reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM resolved GROUP BY 1, 2")
def resolve_coverage(spark, d):
    return resolve.coverage(_resolved(spark, d))


_YEARLY = f"""WITH {_ANNUAL}, v AS (SELECT accession, trim(regexp_replace(concept, '^.*:', '')) AS concept, min(value) AS value, min(unit) AS unit, min(end_date) AS e, min(period_type) AS p FROM annual GROUP BY 1, 2),
g AS (SELECT accession, max(ticker) AS ticker, max(cik) AS cik, max(fiscal_label) AS y, max(filing_date) AS fd FROM filings WHERE upper(form_type) NOT LIKE '%/A' GROUP BY 1),
one AS (SELECT g.cik, g.y, v.concept, arg_max(v.value, (g.fd, g.accession)) AS value, arg_max(v.unit, (g.fd, g.accession)) AS unit, arg_max(v.e, (g.fd, g.accession)) AS e, arg_max(v.p, (g.fd, g.accession)) AS p FROM v JOIN g USING (accession) GROUP BY 1, 2, 3)"""


def _yearly(spark, d):
    """One figure per filer, fiscal year and concept from the newest original filing."""
    filings = table(spark, d, "filings")
    own = facts.annual(_facts(spark, d), filings)
    v = own.groupBy("accession", F.trim(F.regexp_replace("concept", "^.*:", "")).alias("concept")).agg(F.min("value").alias("value"), F.min("unit").alias("unit"), F.min("end_date").alias("e"), F.min("period_type").alias("p"))
    g = filings.filter(~catalog.is_amendment(F.col("form_type"))).groupBy("accession").agg(F.max("cik").alias("cik"), F.max("fiscal_label").alias("y"), F.max("filing_date").alias("fd"))
    by = F.struct("fd", "accession")
    return v.join(g, "accession").groupBy("cik", "y", "concept").agg(*[F.max_by(c, by).alias(c) for c in ("value", "unit", "e", "p")])


def _operand(prefix):
    return {"value": F.col(f"{prefix}.value"), "unit": F.col(f"{prefix}.unit"), "end": F.col(f"{prefix}.e"), "period_type": F.col(f"{prefix}.p")}


def _paired(spark, d, years):
    one = _yearly(spark, d)
    return one.alias("a").join(one.alias("b"), (F.col("a.cik") == F.col("b.cik")) & (F.col("a.concept") == F.col("b.concept")) & (F.col("a.y") - years == F.col("b.y")))


def _half_up(n: str, d: str, places: int) -> str:
    """n / d rounded half up in whole numbers, of decimal columns."""
    u = lambda x: f"replace(({x})::decimal(38,10)::varchar, '.', '')::hugeint"
    return f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END * ((abs({u(n)}) * {2 * 10**places} + abs({u(d)})) // nullif(2 * abs({u(d)}), 0)))::double / {10**places}"


_GUARD = """CASE WHEN a.unit IS DISTINCT FROM b.unit THEN 'unit_mismatch' WHEN a.p IS DISTINCT FROM b.p THEN 'period_mismatch' WHEN a.e = b.e THEN 'period_mismatch' WHEN b.value = 0 THEN 'zero_base' WHEN b.value < 0 THEN 'negative_base' {more} END"""


@query(f"""{_YEARLY}, x AS (SELECT a.cik, a.concept, a.y, a.value AS va, b.value AS vb, {_GUARD.format(more='')} AS error FROM one a JOIN one b ON a.cik = b.cik AND a.concept = b.concept AND b.y = a.y - 1)
SELECT cik, concept, y, CASE WHEN error IS NULL THEN round({_half_up('va - vb', 'vb', 4)} * 100, 2) END AS value, error FROM x""")
def calc_growth(spark, d):
    return _paired(spark, d, 1).select("a.cik", "a.concept", "a.y", F.inline(F.array(calc.growth_pct(_operand("a"), _operand("b"))))).withColumn("value", F.col("value").cast("double"))


@query(f"""{_YEARLY}, x AS (SELECT a.cik, a.concept, a.y, a.value AS va, b.value AS vb, {_GUARD.format(more="WHEN a.value < 0 THEN 'negative_base'")} AS error FROM one a JOIN one b ON a.cik = b.cik AND a.concept = b.concept AND b.y = a.y - 3)
SELECT cik, concept, y, CASE WHEN error IS NULL THEN round((pow(va::varchar::double / vb::varchar::double, 1.0 / 3) - 1) * 100, 2) END AS value, error FROM x""")
def calc_cagr(spark, d):
    return _paired(spark, d, 3).select("a.cik", "a.concept", "a.y", F.inline(F.array(calc.cagr_pct(_operand("a"), _operand("b"), F.lit(3))))).withColumn("value", F.col("value").cast("double"))


def _two(spark, d, num, den):
    one = _yearly(spark, d)
    return one.filter(F.col("concept") == num).alias("a").join(one.filter(F.col("concept") == den).alias("b"), (F.col("a.cik") == F.col("b.cik")) & (F.col("a.y") == F.col("b.y")))


_TWO = "FROM one a JOIN one b ON a.cik = b.cik AND a.y = b.y AND a.concept = '{a}' AND b.concept = '{b}'"


@query(f"""{_YEARLY}, x AS (SELECT a.cik, a.y, a.value AS va, b.value AS vb, CASE WHEN a.unit IS DISTINCT FROM b.unit THEN 'unit_mismatch' WHEN a.e <> b.e THEN 'period_mismatch' WHEN b.value = 0 THEN 'zero_base' END AS error {_TWO.format(a='NetIncomeLoss', b='Revenues')})
SELECT cik, y, CASE WHEN error IS NULL THEN round({_half_up('va', 'vb', 4)} * 100, 2) END AS value, error FROM x""")
def calc_margin(spark, d):
    return _two(spark, d, "NetIncomeLoss", "Revenues").select("a.cik", "a.y", F.inline(F.array(calc.margin_pct(_operand("a"), _operand("b"))))).withColumn("value", F.col("value").cast("double"))


@query(f"""{_YEARLY}, x AS (SELECT a.cik, a.y, a.value AS va, b.value AS vb, CASE WHEN b.value = 0 THEN 'zero_base' END AS error {_TWO.format(a='LongTermDebt', b='StockholdersEquity')})
SELECT cik, y, CASE WHEN error IS NULL THEN {_half_up('va', 'vb', 4)} END AS value, error FROM x""")
def calc_ratio(spark, d):
    return _two(spark, d, "LongTermDebt", "StockholdersEquity").select("a.cik", "a.y", F.inline(F.array(calc.ratio(_operand("a"), _operand("b"))))).withColumn("value", F.col("value").cast("double"))


@query(f"""{_YEARLY} SELECT a.cik, a.y, CASE WHEN a.unit IS DISTINCT FROM b.unit OR a.p IS DISTINCT FROM b.p THEN NULL ELSE (a.value - b.value)::decimal(38,10)::varchar END AS value, CASE WHEN a.unit IS DISTINCT FROM b.unit THEN 'unit_mismatch' WHEN a.p IS DISTINCT FROM b.p THEN 'period_mismatch' END AS error {_TWO.format(a='Assets', b='Liabilities')}""")
def calc_difference(spark, d):
    x = _two(spark, d, "Assets", "Liabilities").select("a.cik", "a.y", F.inline(F.array(calc.difference(_operand("a"), _operand("b")))))
    return x.withColumn("value", F.col("value").cast("string"))


@query(f"""{_YEARLY} SELECT y, concept, count(*) AS filers, CASE WHEN count(DISTINCT coalesce(unit, '')) = 1 THEN sum(value)::decimal(38,10)::varchar END AS value, CASE WHEN count(DISTINCT coalesce(unit, '')) > 1 THEN 'unit_mismatch' END AS error FROM one GROUP BY 1, 2""")
def calc_total(spark, d):
    g = _yearly(spark, d).groupBy("y", "concept").agg(F.count(F.lit(1)).alias("filers"), calc.total(F.col("value"), F.col("unit")).alias("t"))
    return g.select("y", "concept", "filers", F.col("t.value").cast("string").alias("value"), "t.error")


_DISPATCHED = f"""{_YEARLY}, k(computation) AS (VALUES ('growth_pct'), ('cagr_pct'), ('margin_pct'), ('ratio'), ('difference'), ('sum'), ('other')),
sp AS (SELECT cik, concept, arg_max((value, unit, e, p, y), (e, y)) AS l, arg_min((value, unit, e, p, y), (e, y)) AS a, count(*) AS n, sum(value) AS s, count(DISTINCT coalesce(unit, '')) AS us FROM one GROUP BY 1, 2),
dn AS (SELECT cik, y, value, unit, e FROM one WHERE concept = 'Revenues'),
op AS (SELECT sp.cik, sp.concept, computation, l[1] AS va, l[2] AS ua, l[3] AS ea, l[4] AS pa, l[5] - a[5] AS years, CASE WHEN n > 1 THEN a[1] END AS vb, a[2] AS ub, a[3] AS eb, a[4] AS pb, s, us, CASE WHEN computation IN ('margin_pct', 'ratio', 'difference') AND sp.concept = 'NetIncomeLoss' THEN dn.value END AS vd, dn.unit AS ud, dn.e AS ed
  FROM sp CROSS JOIN k LEFT JOIN dn ON dn.cik = sp.cik AND dn.y = l[5]),
o2 AS (SELECT *, CASE WHEN vd IS NOT NULL AND computation IN ('margin_pct', 'ratio', 'difference') THEN computation || '2' WHEN vb IS NULL THEN NULL WHEN computation = 'cagr_pct' AND years < 1 THEN NULL WHEN computation IN ('cagr_pct', 'difference', 'sum', 'ratio') THEN computation ELSE 'growth_pct' END AS o FROM op),
er AS (SELECT *, CASE WHEN o IS NULL THEN 'too_few_operands' WHEN o = 'margin_pct2' THEN CASE WHEN ua IS DISTINCT FROM ud THEN 'unit_mismatch' WHEN ea <> ed THEN 'period_mismatch' WHEN vd = 0 THEN 'zero_base' END WHEN o = 'ratio2' THEN CASE WHEN vd = 0 THEN 'zero_base' END
  WHEN o = 'difference2' THEN CASE WHEN ua IS DISTINCT FROM ud THEN 'unit_mismatch' END WHEN o = 'ratio' THEN CASE WHEN vb = 0 THEN 'zero_base' END WHEN o = 'sum' THEN CASE WHEN us > 1 THEN 'unit_mismatch' END
  WHEN ua IS DISTINCT FROM ub THEN 'unit_mismatch' WHEN pa IS DISTINCT FROM pb THEN 'period_mismatch' WHEN o = 'difference' THEN NULL WHEN ea = eb THEN 'period_mismatch' WHEN vb = 0 THEN 'zero_base' WHEN vb < 0 THEN 'negative_base' WHEN o = 'cagr_pct' AND va < 0 THEN 'negative_base' END AS error FROM o2)
SELECT cik, concept, computation, replace(o, '2', '') AS operation, error, CASE WHEN error IS NULL THEN round(CASE o WHEN 'margin_pct2' THEN {_half_up('va', 'vd', 4)} * 100 WHEN 'ratio2' THEN {_half_up('va', 'vd', 4)} WHEN 'difference2' THEN (va - vd)::varchar::double WHEN 'ratio' THEN {_half_up('va', 'vb', 4)}
  WHEN 'sum' THEN s::varchar::double WHEN 'difference' THEN (va - vb)::varchar::double WHEN 'cagr_pct' THEN (pow(va::varchar::double / vb::varchar::double, 1.0 / years) - 1) * 100 ELSE {_half_up('va - vb', 'vb', 4)} * 100 END, 4) END AS value FROM er"""


@query(_DISPATCHED.replace("THEN (pow(va", "THEN round((pow(va").replace("1.0 / years) - 1) * 100 ELSE", "1.0 / years) - 1) * 100, 2) ELSE"))
def calc_dispatch(spark, d):
    """What each kind of computation gives for every filer and concept: first against last year, or net income against revenue."""
    one = _yearly(spark, d)
    when = F.struct("e", "y")
    row = F.struct("value", "unit", "e", "p", "y")
    sp = one.groupBy("cik", "concept").agg(F.max_by(row, when).alias("l"), F.min_by(row, when).alias("a"), F.count(F.lit(1)).alias("n"), calc.total(F.col("value"), F.col("unit")).alias("summed"))
    dn = one.filter("concept = 'Revenues'").select("cik", F.col("y").alias("dy"), F.col("value").alias("vd"), F.col("unit").alias("ud"), F.col("e").alias("ed"), F.col("p").alias("pd"))
    j = sp.withColumn("dy", F.col("l.y")).join(dn, ["cik", "dy"], "left").withColumn("computation", F.explode(F.array(*[F.lit(k) for k in ("growth_pct", "cagr_pct", "margin_pct", "ratio", "difference", "sum", "other")])))
    two = F.col("concept") == "NetIncomeLoss"
    side = lambda x, v: {"value": v, "unit": F.col(f"{x}.unit"), "end": F.col(f"{x}.e"), "period_type": F.col(f"{x}.p")}
    den = {"value": F.when(two, F.col("vd")), "unit": F.col("ud"), "end": F.col("ed"), "period_type": F.col("l.p")}
    got = calc.dispatch(F.col("computation"), side("l", F.col("l.value")), side("a", F.when(F.col("n") > 1, F.col("a.value"))), den, F.col("l.y") - F.col("a.y"), F.col("summed"))
    return j.select("cik", "concept", "computation", got.alias("c")).select("cik", "concept", "computation", "c.operation", "c.error", F.round(F.col("c.value").cast("double"), 4).alias("value"))


@query(f"""{_YEARLY}, gap AS (SELECT y, concept, count(*) AS filers, max(value) AS hi, min(value) AS lo, arg_max(cik, (value, -cik)) AS highest, arg_min(cik, (value, cik)) AS lowest, count(DISTINCT e) AS ends FROM one GROUP BY y, concept, unit HAVING count(*) > 1)
SELECT y, concept, filers, highest, lowest, (hi - lo)::decimal(38,10)::varchar AS gap, CASE WHEN lo > 0 THEN round({_half_up('hi - lo', 'lo', 4)} * 100, 2) END AS pct_of_low, ends > 1 AS ends_differ FROM gap""")
def compare_gap(spark, d):
    g = _yearly(spark, d).groupBy("y", "concept", "unit").agg(F.count(F.lit(1)).alias("filers"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.max_by("cik", F.struct("value", -F.col("cik"))).alias("highest"), F.min_by("cik", F.struct("value", "cik")).alias("lowest"), F.count_distinct("e").alias("ends")).filter("filers > 1")
    return g.select("y", "concept", "filers", "highest", "lowest", (F.col("hi") - F.col("lo")).cast("decimal(38,10)").cast("string").alias("gap"), F.when(F.col("lo") > 0, (calc.quotient((F.col("hi") - F.col("lo")).cast("decimal(28,10)"), F.col("lo"), 4) * 100).cast("double")).alias("pct_of_low"), (F.col("ends") > 1).alias("ends_differ"))


@query(f"""{_YEARLY}, tr AS (SELECT cik, concept, count(*) AS years, arg_min(value, (e, y)) AS first, arg_max(value, (e, y)) AS last FROM one GROUP BY 1, 2 HAVING count(*) > 1)
SELECT cik, concept, years, (last - first)::decimal(38,10)::varchar AS change, CASE WHEN last > first THEN 'rose' WHEN last < first THEN 'fell' ELSE 'unchanged' END AS direction FROM tr""")
def trend_change(spark, d):
    g = _yearly(spark, d).groupBy("cik", "concept").agg(F.count(F.lit(1)).alias("years"), F.min_by("value", F.struct("e", "y")).alias("first"), F.max_by("value", F.struct("e", "y")).alias("last")).filter("years > 1")
    return g.select("cik", "concept", "years", (F.col("last") - F.col("first")).cast("decimal(38,10)").cast("string").alias("change"), F.when(F.col("last") > F.col("first"), "rose").when(F.col("last") < F.col("first"), "fell").otherwise("unchanged").alias("direction"))
