"""Queries that write tables in the engine's source formats and read them back, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fmt, numerals, questions, textops
from ..operators import catalog, facts, registry
from ..runtime import table
from ..sources import files
from ..streaming import limits
from .book import book
from .filing_queries import _RESOLVED, _filings, _resolved

QUERIES, SQL, query = book()
DAY = "2020-06-30"


@query("SELECT DISTINCT upper(ticker) AS ticker, cik, form_type, accession, period_end, filing_date, primary_doc FROM filings WHERE form_type IN ('10-K', '10-K/A') AND period_end IS NOT NULL AND filing_date IS NOT NULL")
def submissions_read(spark, d):
    """Every filing written into a registry page with a foreign form, an undated row and lists of unequal length, and read back."""
    f = table(spark, d, "filings").select("ticker", "cik", "entity_name", "form_type", "accession", "period_end", "filing_date", "primary_doc").distinct()
    two = lambda a, b: F.array(F.lit(a), F.col(b).cast("string"), F.lit(a))
    recent = F.struct(F.array(F.lit("8-K"), F.col("form_type"), F.lit("10-K"), F.lit("10-K")).alias("form"), two("0", "accession").alias("accessionNumber"), two("", "period_end").alias("reportDate"), two("2020-01-01", "filing_date").alias("filingDate"), two("", "primary_doc").alias("primaryDocument"))
    page = F.to_json(F.struct(F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"), F.col("entity_name").alias("name"), F.array(F.lower("ticker")).alias("tickers"), F.struct(recent.alias("recent")).alias("filings")))
    return catalog.submission_rows(catalog.read_submissions(f.select(page.alias("page")), "page"))


@query("SELECT DISTINCT accession, array_to_string(list_sort(list_filter(list_distinct(list_append(exhibit_docs, primary_doc)), lambda x: regexp_matches(lower(x), '\\.html?$'))), ',') AS names, array_to_string(CASE WHEN len(exhibit_docs) > 0 THEN exhibit_docs[1:8] ELSE [coalesce(primary_doc, '')] END, ',') AS fetched FROM filings")
def summary_files(spark, d):
    """Every filing's documents written into a summary and read back, and those to be fetched."""
    f = table(spark, d, "filings").select("accession", "exhibit_docs", "primary_doc").distinct()
    listed = F.filter(F.array_append("exhibit_docs", F.col("primary_doc")), lambda x: x.isNotNull())
    xml = F.concat(F.lit("<FilingSummary><InputFiles>"), F.array_join(F.transform(F.concat(listed, listed), lambda x: F.concat(F.lit("<File doctype='10-K'>"), x, F.lit("</File>"))), "\n"), F.lit("<File>schema.xsd</File></InputFiles><File>outside.htm</File></FilingSummary>"))
    return f.select("accession", F.array_join(F.array_sort(catalog.input_files(xml)), ",").alias("names"), F.array_join(catalog.documents_to_fetch(F.col("exhibit_docs"), F.col("primary_doc")), ",").alias("fetched"))


@query("SELECT accession, 'x:' || trim(regexp_replace(concept, '^.*:', '')) AS concept, coalesce(start_date::varchar, '') AS start, end_date::varchar AS \"end\", unit, arg_max(value, id)::varchar AS value FROM facts WHERE value IS NOT NULL AND end_date IS NOT NULL AND unit IS NOT NULL AND concept IS NOT NULL AND accession IS NOT NULL GROUP BY 1, 2, 3, 4, 5")
def companyfacts_read(spark, d):
    """Every number as a nested fact document, read back with the last one of a key."""
    f = table(spark, d, "facts").filter("value is not null and end_date is not null and unit is not null and concept is not null and accession is not null")
    name, unit = F.coalesce(F.trim(F.regexp_replace("concept", "^.*:", "")), F.lit("")), F.coalesce("unit", F.lit(""))  # map keys may not be null, even in rows that are filtered out
    row = F.array(F.struct(F.col("accession").alias("accn"), F.col("start_date").cast("string").alias("start"), F.col("end_date").cast("string").alias("end"), F.col("value").cast("string").alias("val")), F.struct(F.lit(None).cast("string").alias("accn"), F.lit("2020").alias("start"), F.lit("2020").alias("end"), F.lit("1").alias("val")))
    doc = F.to_json(F.struct(F.create_map(F.lit("x"), F.create_map(name, F.struct(F.create_map(unit, row).alias("units")))).alias("facts")))
    return files.companyfacts(f.select("id", doc.alias("doc")), "doc", "id").withColumn("value", F.col("value").cast("string"))


@query("SELECT doc_id, md5(trim(text, ' ') || chr(10) || '<!-- next document -->' || chr(10) || coalesce(section_id, '')) AS hash FROM documents WHERE text IS NOT NULL AND NOT contains(lower(text), '<document>') AND trim(text, ' ') <> ''")
def submission_parts(spark, d):
    """Every passage inside a full submission with exhibits, split again."""
    docs = table(spark, d, "documents").filter("text is not null and trim(text) <> '' and not contains(lower(text), '<document>')")
    whole = F.concat(F.lit("<SEC-HEADER>x\n<DOCUMENT>\n<TYPE>10-K405\n<TEXT>"), "text", F.lit("</TEXT>\n</DOCUMENT><DOCUMENT>\n<TYPE>EX-21\n<TEXT>no</TEXT><DOCUMENT>\n<TYPE>EX-13.1\n<TEXT>"), F.coalesce("section_id", F.lit("")), F.lit("</TEXT>"))
    return docs.select("doc_id", F.md5(files.annual_parts(whole)).alias("hash"))


@query("""SELECT DISTINCT accession, CASE WHEN form_type = '10-K' THEN year(period_end) WHEN fiscal_label_source = 'dei' THEN year(period_end) ELSE 1999 + substr(accession, 12, 2)::int END AS year FROM filings WHERE regexp_matches(accession, '^\\d{10}-\\d{2}-')""")
def filing_years(spark, d):
    """Each filing's year from its header, its details or its accession, whichever there is."""
    f = table(spark, d, "filings").filter(F.col("accession").rlike(r"^\d{10}-\d{2}-"))
    header = F.when(F.col("form_type") == "10-K", F.concat(F.lit("CONFORMED PERIOD OF REPORT:\t"), F.date_format("period_end", "yyyyMMdd")))
    details = F.when(F.col("fiscal_label_source") == "dei", F.to_json(F.struct(F.col("period_end").cast("string").alias("reportDate"))))
    return f.select("accession", catalog.fiscal_year(header, details, F.col("accession")).alias("year")).distinct()


@query("SELECT id, max(status) AS status FROM (SELECT id, status FROM turns WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, coalesce(status, '') DESC) = 1) GROUP BY 1")
def json_lines_read(spark, d):
    """Turns as JSON lines between comments, blanks and broken lines: the last row of each id."""
    t = table(spark, d, "turns").filter("id is not null").select("id", "status", F.struct(F.coalesce(F.col("created_at").cast("string"), F.lit("")), F.coalesce("status", F.lit(""))).alias("at"))
    line = F.to_json(F.struct("id", "status"))
    lines = t.select("at", F.explode(F.array(line, F.lit("  "), F.lit("// note"), F.concat(line, F.lit("}")), F.lit("{broken"))).alias("line"))
    return files.parse_json_lines(lines, "line", "at", "id string, status string", "id")


_TITLE = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"""WITH r AS (SELECT upper(ticker) AS ticker, max(entity_name) AS title FROM filings WHERE ticker IS NOT NULL GROUP BY 1), n AS (SELECT DISTINCT unnest([lower(ticker), split_part(entity_name, ' ', 1), split_part(entity_name, ' ', 1) || split_part(entity_name, ' ', 2) || 'zz', 'nobody at all']) AS name FROM filings),
m AS (SELECT n.name, r.ticker, CASE WHEN upper(n.name) = r.ticker THEN 0 ELSE 1 END AS k, length(r.title) AS l FROM n JOIN r ON upper(n.name) = r.ticker OR {_TITLE.format('n.name')} = {_TITLE.format('r.title')} OR (length({_TITLE.format('n.name')}) >= 3 AND contains({_TITLE.format('r.title')}, {_TITLE.format('n.name')})) OR (length({_TITLE.format('r.title')}) >= 3 AND contains({_TITLE.format('n.name')}, {_TITLE.format('r.title')})))
SELECT n.name, arg_min(m.ticker, (m.k, m.l, m.ticker)) AS ticker FROM n LEFT JOIN m USING (name) GROUP BY 1""")
def company_lookup(spark, d):
    """Names in several spellings looked up among all filers."""
    f = table(spark, d, "filings")
    reg = files.companies(f.filter("ticker is not null").groupBy(F.upper("ticker").alias("ticker")).agg(F.max("entity_name").alias("title"), F.max("cik").alias("cik_str")))
    word = lambda i: F.split_part("entity_name", F.lit(" "), F.lit(i))
    names = f.select(F.explode(F.array(F.lower("ticker"), word(1), F.concat(word(1), word(2), F.lit("zz")), F.lit("nobody at all"))).alias("name"))
    return files.find_company(reg, names)


@query("SELECT id, format, value::varchar AS value FROM facts, (VALUES ('dot'), ('comma'), ('apostrophe'), ('parentheses'), ('scaled'), ('zero')) k(format) WHERE value IS NOT NULL AND abs(value) < 1000000000000000 AND format <> 'zero' UNION ALL SELECT id, 'zero', '0.0000000000' FROM facts WHERE value IS NOT NULL AND abs(value) < 1000000000000000")
def number_transforms(spark, d):
    """Every number printed in each tagged format and read back exactly."""
    v = F.col("value")
    plain = fmt.grouped(v)
    sign = F.when(v < 0, "-")
    none = F.lit(None).cast("string")
    swapped = F.translate(plain, ",.", ".,")
    apart = F.replace(plain, F.lit(","), F.lit("'"))
    thousandth = fmt.plain(F.abs(v).cast("decimal(28,10)") / F.lit(1000).cast("decimal(4,0)"))
    kinds = {
        "dot": ("ixt:num-dot-decimal", plain, none, sign), "comma": ("ixt:numcommadecimal", swapped, F.lit("0"), sign), "apostrophe": ("ixt:num-dot-decimal-apos", apart, none, sign), "parentheses": ("ixt:numdotdecimal", F.when(v < 0, F.concat(F.lit("("), plain, F.lit(")"))).otherwise(plain), none, none),
        "scaled": ("ixt:num-dot-decimal", thousandth, F.lit("3"), sign), "zero": ("ixt:fixed-zero", F.lit("-"), none, none),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("format"), F.lit(f).alias("f"), t.alias("t"), s.alias("s"), g.alias("g")) for k, (f, t, s, g) in kinds.items()])
    x = table(spark, d, "facts").filter("value is not null and abs(value) < 1000000000000000").select("id", F.explode(rows).alias("k"))
    return x.select("id", "k.format", numerals.tagged_number(F.col("k.f"), F.col("k.t"), F.col("k.s"), F.col("k.g")).cast("string").alias("value"))


@query("SELECT DISTINCT accession, '/Archives/edgar/data/' || cik::varchar || '/' || replace(accession, '-', '') || '/' || primary_doc AS path FROM filings")
def archive_paths(spark, d):
    return table(spark, d, "filings").select("accession", fmt.archive_path(F.col("cik"), F.col("accession"), F.col("primary_doc")).alias("path")).distinct()


@query("SELECT doc_id, md5(text) AS plain, coalesce(section_id = 'notes', false) AS refused, md5(to_json({'section': section_id})::varchar) AS json FROM documents WHERE text IS NOT NULL AND section_id IS NOT NULL AND NOT contains(text, '<')")
def page_cleaning(spark, d):
    """Tagged passages without their tags, refusal pages told apart, and JSON taken out of replies."""
    docs = table(spark, d, "documents").filter("text is not null and section_id is not null and not contains(text, '<')")
    tagged = F.concat(F.lit('<ix:nonNumeric name="a">'), "text", F.lit("</ix:nonNumeric><xbrli:unit/>"))
    page = F.concat(F.when(F.col("section_id") == "notes", "<html>Your Request Originates from an Undeclared Automated Tool").otherwise("<html>"), "text")
    json = F.to_json(F.struct(F.col("section_id").alias("section")))
    reply = F.concat(F.lit("Here you are:\n```json\n"), json, F.lit("\n```\nAnything else?"))
    return docs.select("doc_id", F.md5(textops.strip_tags(tagged)).alias("plain"), textops.is_error_page(page).alias("refused"), F.md5(textops.embedded_json(reply)).alias("json"))


@query("""WITH f AS (SELECT accession, trim(regexp_replace(concept, '^.*:', '')) AS concept, coalesce(start_date::varchar, '') AS s, end_date, unit, value FROM facts WHERE value IS NOT NULL AND concept IS NOT NULL AND end_date IS NOT NULL),
u AS (SELECT *, CASE WHEN lower(coalesce(unit, '')) = 'usd-per-shares' THEN 'USD/shares' ELSE coalesce(unit, '') END AS n FROM f), o AS (SELECT accession, concept, s, end_date, n, min(value) AS theirs FROM u GROUP BY 1, 2, 3, 4, 5)
SELECT u.accession, u.concept, u.s AS start, u.end_date::varchar AS "end", u.unit, count(*) AS facts, count(*) FILTER (WHERE u.value = o.theirs) AS exact FROM u JOIN o USING (accession, concept, s, end_date, n) GROUP BY u.accession, u.concept, u.s, u.end_date, u.unit""")
def oracle_join(spark, d):
    """Every number against the least one stated under its five keys, units under any name."""
    f = table(spark, d, "facts").filter("value is not null and concept is not null and end_date is not null")
    f = f.select("accession", F.trim(F.regexp_replace("concept", "^.*:", "")).alias("concept"), F.col("start_date").cast("string").alias("start"), F.col("end_date").cast("string").alias("end"), "unit", "value")
    j = files.join_oracle(f, f)
    return j.groupBy("accession", "concept", "start", "end", "unit").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("value") == F.col("theirs")).alias("exact"))


_OPS = "split_part(request_id, '/', 1) AS o, split_part(request_id, '/', 3) AS kind, split_part(request_id, '/', 4) AS day, split_part(request_id, '/', 5) AS asked"


@query(f"""{_RESOLVED}, r1 AS (SELECT *, {_OPS} FROM resolved WHERE status = 'resolved') SELECT DISTINCT a.request_id, a.value AS numerator, b.value AS denominator FROM r1 a JOIN r1 b ON a.metric = 'net_income' AND b.metric = 'total_assets' AND b.kind = 'fiscal_label' AND b.ticker = a.ticker AND b.fiscal_label = a.fiscal_label AND b.day = a.day AND b.asked = a.fiscal_label::varchar""")
def operand_pairs(spark, d):
    """Net income of every request with total assets of the same ticker, day and fiscal label."""
    part = lambda i: F.split_part("request_id", F.lit("/"), F.lit(i))
    r = _resolved(spark, d, metrics=("net_income", "total_assets")).filter("status = 'resolved'").select("request_id", "metric", "ticker", "fiscal_label", F.col("value").cast("string").alias("value"), part(3).alias("kind"), part(4).alias("day"), part(5).alias("asked"))
    a = r.filter("metric = 'net_income'").select("request_id", "ticker", "fiscal_label", "day", F.col("value").alias("numerator"))
    b = r.filter("metric = 'total_assets' and kind = 'fiscal_label' and asked = cast(fiscal_label as string)").select("ticker", "fiscal_label", "day", F.col("value").alias("denominator")).distinct()
    return a.join(b, ["ticker", "fiscal_label", "day"]).select("request_id", "numerator", "denominator").distinct()


@query("""WITH h AS (SELECT ticker AS doc, doc_id AS line_no, section_id AS section FROM documents WHERE ticker IS NOT NULL AND section_id IS NOT NULL), l AS (SELECT doc, max(line_no) + 10 AS lines FROM h GROUP BY 1),
s AS (SELECT h.*, coalesce(lead(line_no) OVER (PARTITION BY h.doc ORDER BY line_no), lines) AS until FROM h JOIN l USING (doc)), k AS (SELECT *, row_number() OVER (PARTITION BY doc, section ORDER BY until - line_no DESC, line_no) AS k FROM s)
SELECT doc, line_no, until, CASE WHEN k = 1 THEN section ELSE section || '__' || k::varchar END AS part FROM k""")
def section_slices(spark, d):
    """Slices between headings, several of one section told apart by length; passages stand in for headings."""
    h = table(spark, d, "documents").filter("ticker is not null and section_id is not null").select(F.col("ticker").alias("doc"), F.col("doc_id").alias("line_no"), F.col("section_id").alias("section"))
    lengths = h.groupBy("doc").agg((F.max("line_no") + 10).alias("lines"))
    return textops.slices(h, "doc", "line_no", lengths).select("doc", "line_no", "until", "part")


@query("""WITH a AS (SELECT model AS k, max(prompt_tokens) AS rpm, CASE WHEN min(model) > 'm' THEN max(completion_tokens) END AS tpm FROM responses GROUP BY 1), b AS (SELECT model AS k, 7 AS rpm, 9 AS tpm FROM responses GROUP BY 1 UNION ALL SELECT DISTINCT provider, 1, 2 FROM responses)
SELECT coalesce(a.k, b.k) AS k, coalesce(a.rpm, b.rpm) AS rpm, coalesce(a.tpm, b.tpm) AS tpm FROM a FULL JOIN b ON a.k = b.k""")
def learned_limits(spark, d):
    """Stored limits with the learned ones in their place."""
    r = table(spark, d, "responses")
    learned = r.groupBy(F.col("model").alias("k")).agg(F.max("prompt_tokens").alias("rpm"), F.when(F.min("model") > "m", F.max("completion_tokens")).alias("tpm"))
    stored = r.select(F.col("model").alias("k"), F.lit(7).alias("rpm"), F.lit(9).alias("tpm")).distinct().unionByName(r.select(F.col("provider").alias("k"), F.lit(1).alias("rpm"), F.lit(2).alias("tpm")).distinct())
    return limits.merged_limits(learned, stored, "k")


_CALLS = """c AS (SELECT turn_id, dense_rank() OVER (ORDER BY model) AS position, model AS candidate, row_number() OVER (PARTITION BY turn_id, model ORDER BY created_at, key) AS attempt, CASE WHEN content IS NULL THEN 'rate_limited' WHEN length(content) < 40 THEN 'empty' ELSE 'ok' END AS outcome FROM responses WHERE turn_id IS NOT NULL)"""


@query(f"""WITH {_CALLS}, g AS (SELECT *, coalesce(max(CASE WHEN outcome <> 'rate_limited' THEN 1 ELSE 0 END) OVER (PARTITION BY turn_id, position ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM c WHERE attempt <= 3),
m AS (SELECT *, coalesce(max(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY turn_id ORDER BY position, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ok FROM g WHERE gone = 0)
SELECT turn_id, arg_max(candidate, (position, attempt)) AS candidate, count(*) AS tries, arg_max(outcome, (position, attempt)) AS outcome FROM m WHERE ok = 0 GROUP BY 1""")
def model_failover(spark, d):
    """Which model answers each turn, with the replies as calls."""
    from pyspark.sql.window import Window

    r = table(spark, d, "responses").filter("turn_id is not null")
    models = r.select("model").distinct().withColumn("position", F.row_number().over(Window.orderBy("model")))  # one row a model
    outcome = F.when(F.col("content").isNull(), "rate_limited").when(F.length("content") < 40, "empty").otherwise("ok")
    attempt = F.row_number().over(Window.partitionBy("turn_id", "model").orderBy("created_at", "key"))
    calls = r.join(F.broadcast(models), "model").select("turn_id", "position", F.col("model").alias("candidate"), attempt.alias("attempt"), outcome.alias("outcome"))
    return limits.failover(calls, "turn_id")


@query("SELECT name, row_number() OVER (ORDER BY rank, name) AS position FROM (SELECT model AS name, max(completion_tokens) AS rank, CASE WHEN contains(model, '-') THEN ['json', 'long'] ELSE ['json'] END AS caps FROM responses GROUP BY 1) WHERE list_contains(caps, 'json') AND list_contains(caps, 'long')")
def role_order(spark, d):
    """Models fit for a role, by their longest reply."""
    caps = F.when(F.contains("model", F.lit("-")), F.array(F.lit("json"), F.lit("long"))).otherwise(F.array(F.lit("json")))
    c = table(spark, d, "responses").groupBy(F.col("model").alias("name")).agg(F.max("completion_tokens").alias("rank"), F.first(caps).alias("caps"))
    return limits.order_for_role(c, ["json", "long"]).select("name", "position")


_METRICS = "', '".join(registry.METRICS)


@query(f"""SELECT DISTINCT outcome_id, query_type, upper(ticker) AS ticker, fiscal_label AS year FROM outcomes WHERE query_type IN ('{"', '".join(questions.QUERY_TYPES)}') AND fiscal_label BETWEEN 1993 AND 2100 AND coalesce(abstain_reason, 'revenue') IN ('{_METRICS}')""")
def model_routes(spark, d):
    """Routes that a model may answer with, as JSON, read and checked; those with a value not allowed are dropped."""
    o = table(spark, d, "outcomes").select("outcome_id", "query_type", "ticker", "fiscal_label", "abstain_reason").distinct()
    reply = F.to_json(F.struct("query_type", F.array(F.lower("ticker")).alias("tickers"), F.array("fiscal_label").alias("years"), F.coalesce("abstain_reason", F.lit("revenue")).alias("metric")))
    r = o.select("outcome_id", questions.route_from_json(reply).alias("r")).filter("r is not null")
    return r.select("outcome_id", "r.query_type", F.get("r.tickers", F.lit(0)).alias("ticker"), F.get("r.years", F.lit(0)).alias("year")).distinct()


@query("""WITH a(alias, metric) AS (VALUES {A}), n AS (SELECT DISTINCT unnest([alias, upper(alias), '  ' || replace(alias, ' ', '   ') || '!', alias || ' x']) AS name, metric FROM a) SELECT name, CASE WHEN name LIKE '% x' THEN NULL ELSE metric END AS metric FROM n""".replace("{A}", ", ".join(f"('{a}', '{m}')" for m, (_, _, _, names) in registry.METRICS.items() for a in names)))
def alias_lookup(spark, d):
    """Every alias of every metric in several spellings."""
    a = registry.aliases(spark)
    names = a.select(F.explode(F.array("alias", F.upper("alias"), F.concat(F.lit("  "), F.replace("alias", F.lit(" "), F.lit("   ")), F.lit("!")), F.concat("alias", F.lit(" x")))).alias("name")).distinct()
    return questions.resolve_alias(names, "name", a)


@query("""WITH f AS (SELECT id, accession, trim(regexp_replace(concept, '^.*:', '')) AS concept, unit, decimals IS NULL AS odd, value FROM facts), c AS (SELECT * FROM f WHERE value IS NOT NULL AND NOT odd) SELECT accession, count(*) AS facts, count(DISTINCT concept) AS concepts FROM c GROUP BY 1""")
def consolidated_facts(spark, d):
    """Numeric facts without dimensions; those of undeclared precision stand in for facts of a segment."""
    f = table(spark, d, "facts").withColumn("dimensions", F.when(F.col("decimals").isNull(), F.array(F.lit("segment"))).otherwise(F.array().cast("array<string>")))
    own = facts.numeric(f).withColumn("concept", F.trim(F.regexp_replace("concept", "^.*:", "")))
    return own.groupBy("accession").agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("concept").alias("concepts"))


@query("""WITH t AS (SELECT key, regexp_replace(coalesce(content, ''), '(?i)\\b10-[KQ]\\b|\\b8-K\\b|\\bitem\\s+\\d+[a-c]?\\b|\\bsection\\s+\\d+\\b|\\basc\\s+\\d+\\b|\\bifrs\\s+\\d+\\b|\\bnote\\s+\\d+\\b', ' ', 'g') AS t FROM responses),
n AS (SELECT key, unnest(regexp_extract_all(t, '(?i)(?:\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?)\\s*(?:(?:trillion|billion|million|thousand|bn|mm|[btmk])\\b)?(?:\\s*%)?')) AS x FROM t)
SELECT key, count(*) AS numbers, count(*) FILTER (WHERE x LIKE '%\\%' ESCAPE '\\') AS percents FROM n GROUP BY 1""")
def legacy_numbers(spark, d):
    """Quantities of every reply in the older reading: names of forms, items, notes and standards are none."""
    n = table(spark, d, "responses").select("key", F.explode(numerals.legacy_numbers(F.col("content"))).alias("n"))
    return n.groupBy("key").agg(F.count(F.lit(1)).alias("numbers"), F.count_if("n.is_percent").alias("percents"))
