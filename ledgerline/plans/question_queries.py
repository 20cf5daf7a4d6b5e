"""Queries over questions, answers, documents' text and evaluation tables, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numerals, questions, textops
from ..functions.text import accession_key, amount, iso_day, local_name
from ..operators import evaluate
from ..runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
YEAR = 2026


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _chain(rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(query, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in rules) + f" ELSE {default} END"


def _computation_sql() -> str:
    """The rules without lookahead: "less than" is taken out of the text before "less" is looked for."""
    out = "NULL"
    for name, p in reversed(questions.COMPUTATION):
        text, pattern = "query", p
        if "(?!" in p:
            text, pattern = "regexp_replace(query, '(?i)\\bless\\s+than', ' ', 'g')", p.replace(r"(?!\s+than)", "")
        out = f"CASE WHEN regexp_matches({text}, '{pattern.replace(chr(39), chr(39) * 2)}') THEN '{name}' ELSE {out} END"
    return out


@query(f"SELECT outcome_id, {_chain(questions.FOCUS, chr(39) + 'other' + chr(39))} AS focus FROM (SELECT DISTINCT outcome_id, query FROM outcomes)")
def focus_classify(spark, d):
    return table(spark, d, "outcomes").select("outcome_id", "query").distinct().select("outcome_id", questions.focus(F.col("query")).alias("focus"))


@query(f"SELECT outcome_id, {_computation_sql()} AS computation, {_chain(tuple((m, p) for p, m in questions.MARGINS), 'NULL')} AS margin FROM (SELECT DISTINCT outcome_id, query FROM outcomes)")
def computation_classify(spark, d):
    """Computation and margin of every question."""
    q = table(spark, d, "outcomes").select("outcome_id", "query").distinct()
    return q.select("outcome_id", questions.computation(F.col("query")).alias("computation"), questions.margin_metric(F.col("query")).alias("margin"))


_FY = "(?i)\\b(?:fiscal\\s+year|fiscal|fy)\\s*[-:]?\\s*(\\d{4}|\\d{2})\\b"
_YR = "\\b((?:19|20)\\d{2})\\b"


@query(f"""WITH q AS (SELECT DISTINCT outcome_id, coalesce(query, '') AS q FROM outcomes),
x AS (SELECT *, list_transform(regexp_extract_all(q, '{_FY}', 1), lambda y: CASE WHEN y::int < 100 THEN y::int + 2000 ELSE y::int END) AS fy, list_transform(regexp_extract_all(q, '{_YR}', 1), lambda y: y::int) AS yr FROM q),
l AS (SELECT *, CASE WHEN len(fy) > 0 THEN fy WHEN len(yr) > 0 THEN yr END AS ls FROM x),
b AS (SELECT *, list_filter(ls, lambda y: y < 1993 OR y > {YEAR + 1}) AS bad FROM l)
SELECT outcome_id, CASE WHEN len(bad) > 0 THEN 'none' WHEN ls IS NOT NULL THEN 'fiscal_label' WHEN regexp_matches(q, '(?i)\\blast\\s+year\\b|\\b(?:prior|previous)\\s+year\\b|\\bthis\\s+year\\b') THEN 'fiscal_label' WHEN regexp_matches(q, '(?i)\\b(?:latest|newest|current)\\b') THEN 'latest' ELSE 'none' END AS kind,
 CASE WHEN len(bad) > 0 THEN '' ELSE coalesce(array_to_string(list_sort(list_distinct(ls)), ','), '') END AS labels, CASE WHEN len(bad) > 0 THEN CASE WHEN bad[1] > {YEAR + 1} THEN 'future_period' ELSE 'period_not_covered' END END AS reason FROM b""")
def period_parse(spark, d):
    q = table(spark, d, "outcomes").select("outcome_id", "query").distinct()
    p = q.select("outcome_id", questions.period(F.col("query"), YEAR).alias("p"))
    return p.select("outcome_id", "p.kind", F.array_join(F.col("p.labels").cast("array<string>"), ",").alias("labels"), "p.reason")


@query()
def route_questions(spark, d):
    """Path, reason, intent and metrics of every question, its ticker counted as one entity."""
    q = table(spark, d, "outcomes").select("outcome_id", "query", "ticker").distinct()
    n = F.when(F.col("ticker").isNull(), 0).otherwise(1)
    p = questions.period(F.col("query"), YEAR)
    r = q.withColumn("p", p).withColumn("r", questions.route(F.col("query"), n, F.col("p")))
    return r.select("outcome_id", "r.path", "r.reason", questions.intent(F.col("query"), n, F.col("p")).alias("intent"), F.array_join("r.metrics", ",").alias("metrics"))


@query(f"""WITH q AS (SELECT DISTINCT outcome_id, coalesce(query, '') AS q FROM outcomes),
x AS (SELECT *, list_transform(regexp_extract_all(q, '{_FY}', 1), lambda y: CASE WHEN y::int < 100 THEN y::int + 2000 ELSE y::int END) AS fy, list_transform(regexp_extract_all(q, '{_YR}', 1), lambda y: y::int) AS yr FROM q),
l AS (SELECT *, CASE WHEN len(fy) > 0 THEN fy WHEN len(yr) > 0 THEN yr END AS ls FROM x),
b AS (SELECT *, list_filter(ls, lambda y: y < 1993 OR y > {YEAR + 1}) AS bad FROM l)
SELECT outcome_id, CASE WHEN ls IS NOT NULL AND len(bad) = 0 THEN 'fiscal_label' WHEN len(bad) > 0 THEN 'latest' WHEN regexp_matches(q, '(?i)\\blast\\s+year\\b|\\b(?:prior|previous)\\s+year\\b|\\bthis\\s+year\\b') THEN 'fiscal_label' ELSE 'latest' END AS kind,
 CASE WHEN ls IS NOT NULL AND len(bad) = 0 THEN unnest(list_sort(list_distinct(ls))) END AS label FROM b WHERE ls IS NOT NULL AND len(bad) = 0
UNION ALL SELECT outcome_id, CASE WHEN len(bad) = 0 OR bad IS NULL THEN CASE WHEN regexp_matches(q, '(?i)\\blast\\s+year\\b|\\b(?:prior|previous)\\s+year\\b|\\bthis\\s+year\\b') THEN 'fiscal_label' ELSE 'latest' END ELSE 'latest' END, CASE WHEN (len(bad) = 0 OR bad IS NULL) AND regexp_matches(q, '(?i)\\blast\\s+year\\b|\\b(?:prior|previous)\\s+year\\b') THEN {YEAR - 1} WHEN (len(bad) = 0 OR bad IS NULL) AND regexp_matches(q, '(?i)\\bthis\\s+year\\b') THEN {YEAR} END FROM b WHERE NOT (ls IS NOT NULL AND len(bad) = 0)""")
def period_selectors(spark, d):
    """The periods to resolve for every question, one row each."""
    q = table(spark, d, "outcomes").select("outcome_id", "query").distinct()
    s = q.select("outcome_id", questions.period(F.col("query"), YEAR).alias("p")).select("outcome_id", F.explode(questions.selectors(F.col("p"))).alias("s"))
    return s.select("outcome_id", "s.kind", "s.label")


@query(r"""WITH w AS (SELECT DISTINCT outcome_id, unnest(list_transform(regexp_extract_all(coalesce(query, ''), '[A-Za-z0-9&.$]+'), lambda w: regexp_replace(regexp_replace(w, '^\$+', ''), '\.+$', ''))) AS w FROM outcomes)
SELECT DISTINCT outcome_id, upper(w) AS ticker FROM w WHERE w <> '' AND (length(w) >= 3 OR w = upper(w)) AND upper(w) IN (SELECT ticker FROM filings UNION ALL SELECT upper(split_part(entity_name, ' ', 1)) FROM filings)""")
def ticker_candidates(spark, d):
    """Words of every question that are known tickers, or the first word of a filer's name."""
    f = table(spark, d, "filings")
    known = f.select("ticker").unionByName(f.select(F.upper(F.split_part("entity_name", F.lit(" "), F.lit(1))).alias("ticker"))).distinct()
    q = table(spark, d, "outcomes").select("outcome_id", "query").distinct()
    return q.select("outcome_id", F.explode(questions.ticker_tokens(F.col("query"))).alias("ticker")).join(known, "ticker", "left_semi").select("outcome_id", "ticker").distinct()


@query(r"""WITH w AS (SELECT DISTINCT outcome_id, unnest(regexp_extract_all(coalesce(query, ''), '\b\p{Lu}[\p{L}\p{N}&]*(?:\s+\p{Lu}[\p{L}\p{N}&]*)*')) AS w FROM outcomes), l AS (SELECT outcome_id, regexp_replace(regexp_replace(w, '@LEAD', ''), '@LEAD', '') AS phrase FROM w)
SELECT DISTINCT outcome_id, phrase FROM l WHERE length(phrase) >= 3 AND NOT regexp_matches(lower(phrase), '@WORD') AND NOT regexp_matches(phrase, '^\d+$')""".replace("@LEAD", "(?i)^(?:" + "|".join(questions.LEADS) + ")\\s+").replace("@WORD", "^(?:" + "|".join(questions.LEADS) + ")$"))
def unresolved_mentions(spark, d):
    """Capitalised phrases of every question."""
    q = table(spark, d, "outcomes").select("outcome_id", "query").distinct()
    return q.select("outcome_id", F.explode(questions.capitalised(F.col("query"))).alias("phrase")).distinct()


@query(r"""WITH q AS (SELECT DISTINCT outcome_id, ticker, regexp_extract_all(coalesce(query, ''), '\b((?:19|20)\d{2})\b', 1) AS y FROM outcomes WHERE ticker IS NOT NULL)
SELECT DISTINCT outcome_id, ticker, unnest(y)::int AS year FROM q UNION SELECT outcome_id, ticker, NULL FROM q WHERE len(y) = 0""")
def question_parts(spark, d):
    """Every question taken apart by ticker and year."""
    q = table(spark, d, "outcomes").filter("ticker is not null").select("outcome_id", "ticker", "query").distinct()
    years = F.transform(F.regexp_extract_all(F.coalesce("query", F.lit("")), F.lit(questions.YEAR), F.lit(1)), lambda y: y.cast("int"))
    return q.select("outcome_id", F.explode(questions.decompose(F.array("ticker"), years)).alias("x")).select("outcome_id", "x.ticker", "x.year").distinct()


@query("""WITH m AS (SELECT key, regexp_extract_all(coalesce(content, ''), 'USD (\\d+(?:\\.\\d+)?) million', 1) AS x FROM responses), u AS (SELECT key, unnest(x) AS v FROM m)
SELECT key, sum(v::decimal(18,4) * 1000000)::double AS dollars FROM u GROUP BY 1""")
def numeral_dollars(spark, d):
    found = table(spark, d, "responses").select("key", F.explode(numerals.numerals(F.regexp_replace(F.coalesce("content", F.lit("")), r"USD (\d)", "\\$ $1"))).alias("n"))
    return found.filter(F.col("n.raw").startswith("$") & F.col("n.raw").contains("million")).groupBy("key").agg(F.sum("n.value").cast("double").alias("dollars"))


@query("""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE trunc(length(text) / CASE WHEN (length(text) - length(replace(text, '|', ''))) / length(text) >= 0.02 THEN 2.0 ELSE 4.0 END)::int + 1 END AS tokens FROM documents WHERE text IS NOT NULL""")
def token_estimate(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", textops.estimate_tokens(F.col("text")).alias("tokens"))


def compressed_sql(text: str) -> str:
    """DuckDB expression of ``textops.compress_rows``: cells equal to the one before are dropped segment by segment."""
    line = r"CASE WHEN contains(x, '|') AND NOT contains(x, '---') THEN regexp_replace(array_to_string(list_filter(string_split(rtrim(x), '|'), lambda c, i: i < 3 OR c = '' OR c <> string_split(rtrim(x), '|')[i - 1]), '|'), '(\|\s*)+$', '|') ELSE x END"
    lines = f"list_transform(string_split({text}, chr(10)), lambda x: {line})"
    total = r"regexp_matches(ltrim(y), '(?i)^\|\s*total\b')"
    return f"array_to_string(CASE WHEN len({lines}) > 3 THEN list_concat(list_concat({lines}[1:2], list_filter({lines}[3:], lambda y: {total})), list_filter({lines}[3:], lambda y: NOT {total})) ELSE {lines} END, chr(10))"


@query(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {compressed_sql('text')} END AS text FROM documents")
def compress_rows(spark, d):
    return table(spark, d, "documents").select("doc_id", textops.compress_rows(F.col("text")).alias("text"))


@query("""WITH t AS (SELECT id, min(answer) AS answer FROM turns GROUP BY 1) SELECT id, len(regexp_extract_all(answer, '\\[\\d+\\]')) AS markers FROM t""")
def marker_counts(spark, d):
    t = table(spark, d, "turns").groupBy("id").agg(F.min("answer").alias("answer"))
    return t.select("id", F.size(F.regexp_extract_all(textops.normalize_markers(F.col("answer")), F.lit(r"(\[\d+\])"), F.lit(1))).alias("markers"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE trim(line) = '') AS blank, count(*) FILTER (WHERE line LIKE '|%') AS rows, max(length(line)) AS longest FROM l GROUP BY 1""")
def line_profile(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.trim("line") == "").alias("blank"), F.count_if(F.col("line").startswith("|")).alias("rows"), F.max(F.length("line")).alias("longest"))


@query()
def chunk_sentences(spark, d):
    return textops.chunks(table(spark, d, "documents"), "doc_id", "text", max_tokens=200, overlap=2)


@query("""WITH t AS (SELECT ticker, fiscal_year, doc_id, CASE WHEN text = '' THEN 0 ELSE trunc(length(text) / CASE WHEN (length(text) - length(replace(text, '|', ''))) / length(text) >= 0.02 THEN 2.0 ELSE 4.0 END)::int + 1 END AS tokens FROM documents WHERE ticker IS NOT NULL AND fiscal_year IS NOT NULL AND text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY doc_id) AS position, sum(tokens) OVER (PARTITION BY ticker, fiscal_year ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM t)
SELECT ticker, fiscal_year, doc_id, position, tokens, least(tokens, 1500) AS taken FROM r WHERE s <= 1500 OR position = 1""")
def context_pack(spark, d):
    """Each ticker and year's passages packed in order into a budget of 1,500 estimated tokens."""
    docs = table(spark, d, "documents").filter("ticker is not null and fiscal_year is not null and text is not null")
    return textops.pack_context(docs, ["ticker", "fiscal_year"], "doc_id", "text", 1500)


@query("SELECT key, sha256(concat_ws('|', coalesce(provider, ''), coalesce(model, ''), coalesce(prompt_version, ''), coalesce(turn_id, ''))) AS cache_key FROM responses")
def cache_keys(spark, d):
    return table(spark, d, "responses").select("key", textops.cache_key("provider", "model", "prompt_version", "turn_id").alias("cache_key"))


_W = "{b} AS low, {c} AS high"


def _wilson(k: str, n: str, sign: str) -> str:
    f = "greatest(0.0" if sign == "-" else "least(1.0"
    return f"round({f}, ({k}::double / {n} + 1.96 * 1.96 / (2 * {n}) {sign} 1.96 * sqrt(({k}::double / {n}) * (1 - {k}::double / {n}) / {n} + 1.96 * 1.96 / (4.0 * {n} * {n}))) / (1 + 1.96 * 1.96 / {n})), 6)"


@query(f"""WITH o AS (SELECT DISTINCT outcome_id, query_type, status FROM outcomes), g AS (SELECT query_type, count(*) AS n, count(*) FILTER (WHERE status LIKE 'answered%') AS passed FROM o GROUP BY ROLLUP (query_type))
SELECT query_type, n, passed, round(passed / n, 6) AS rate, {_wilson('passed', 'n', '-')} AS low, {_wilson('passed', 'n', '+')} AS high FROM g""")
def wilson_by_category(spark, d):
    o = table(spark, d, "outcomes").select("outcome_id", "query_type", "status").distinct()
    return evaluate.summarize(o, "query_type", F.col("status").startswith("answered"))


@query("""WITH r AS (SELECT provider, completion_tokens AS v, row_number() OVER (PARTITION BY provider ORDER BY completion_tokens) AS k, count(*) OVER (PARTITION BY provider) AS n FROM responses WHERE completion_tokens IS NOT NULL)
SELECT provider, v AS p95 FROM r WHERE k = round_even(0.95 * (n - 1), 0) + 1""")
def token_percentile(spark, d):
    return evaluate.nearest_rank(table(spark, d, "responses"), ["provider"], "completion_tokens", 0.95, "p95")


@query("""SELECT provider, model, count(*) AS calls, sum(prompt_tokens)::bigint AS prompt_tokens, sum(completion_tokens)::bigint AS completion_tokens, max(completion_tokens) AS most, median(completion_tokens) AS typical FROM responses GROUP BY 1, 2""")
def model_totals(spark, d):
    return table(spark, d, "responses").groupBy("provider", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.max("completion_tokens").alias("most"), F.median("completion_tokens").alias("typical"))


_ACC = "coalesce(CASE WHEN length(regexp_replace(accession, '[^0-9]', '', 'g')) = 18 THEN substr(regexp_replace(accession, '[^0-9]', '', 'g'), 1, 10) || '-' || substr(regexp_replace(accession, '[^0-9]', '', 'g'), 11, 2) || '-' || substr(regexp_replace(accession, '[^0-9]', '', 'g'), 13, 6) END, accession)"


@query(f"""WITH r AS (SELECT side, {_ACC} AS accession, concept_group, our_value_usd, regexp_replace(trim(companyfacts_value), '[,\\s$]', '', 'g') AS t FROM ixbrl_crosscheck),
a AS (SELECT accession, concept_group, min(try_cast(our_value_usd::varchar AS decimal(38,10))) AS o FROM r WHERE side = 'ours' GROUP BY 1, 2),
b AS (SELECT accession, concept_group, min(try_cast(CASE WHEN t LIKE '(%)' THEN '-' || replace(replace(t, '(', ''), ')', '') ELSE t END AS decimal(38,10))) AS v FROM r WHERE side = 'companyfacts' GROUP BY 1, 2),
j AS (SELECT a.*, b.v FROM a LEFT JOIN b USING (accession, concept_group))
SELECT accession, concept_group, CASE WHEN v IS NULL THEN 'not_in_oracle' WHEN o IS NULL THEN 'not_in_ours' WHEN o = v THEN 'exact' WHEN o = -v AND o <> 0 THEN 'sign_error'
 WHEN o <> 0 AND v <> 0 AND list_bool_or(list_transform(range(1, 13), lambda p: abs(o)::hugeint = abs(v)::hugeint * (10::hugeint ** p)::hugeint OR abs(v)::hugeint = abs(o)::hugeint * (10::hugeint ** p)::hugeint)) THEN 'scale_error' ELSE 'mismatch' END AS verdict FROM j""")
def crosscheck_classify(spark, d):
    r = table(spark, d, "ixbrl_crosscheck").withColumn("accession", F.coalesce(accession_key(F.col("accession")), F.col("accession")))
    a = r.filter("side = 'ours'").groupBy("accession", "concept_group").agg(F.min(F.col("our_value_usd").try_cast("decimal(38,10)")).alias("o"))
    b = r.filter("side = 'companyfacts'").groupBy("accession", "concept_group").agg(F.min(amount(F.col("companyfacts_value"))).alias("v"))
    j = a.join(b, ["accession", "concept_group"], "left")
    verdict = F.when(F.col("v").isNull(), "not_in_oracle").when(F.col("o").isNull(), "not_in_ours").otherwise(evaluate.classify_difference(F.col("o"), F.col("v")))
    return j.select("accession", "concept_group", verdict.alias("verdict"))


_SPEC = ", ".join(f"('{s}', {lo}, {hi})" for s, (lo, hi) in evaluate.SECTIONS.items())
_AUDIT = f"""spec(section_id, lo, hi) AS (VALUES {_SPEC}), l AS (SELECT ticker, fiscal_year, section_id, sum(length(text))::bigint AS chars FROM documents WHERE ticker IS NOT NULL AND fiscal_year IS NOT NULL GROUP BY 1, 2, 3),
k AS (SELECT DISTINCT ticker, fiscal_year FROM l),
audit AS (SELECT k.ticker, k.fiscal_year, spec.section_id, l.chars, CASE WHEN l.chars IS NULL THEN 'missing' WHEN l.chars = 0 THEN 'empty' WHEN l.chars < lo THEN 'too_small' WHEN l.chars > hi THEN 'too_large' ELSE 'ok' END AS verdict
  FROM k CROSS JOIN spec LEFT JOIN l ON l.ticker = k.ticker AND l.fiscal_year = k.fiscal_year AND l.section_id = spec.section_id)"""


def _audit(spark, d):
    docs = table(spark, d, "documents").filter("ticker is not null and fiscal_year is not null")
    return evaluate.section_audit(docs.groupBy("ticker", "fiscal_year", "section_id").agg(F.sum(F.length("text")).alias("chars")), ["ticker", "fiscal_year"])


@query(f"WITH {_AUDIT} SELECT * FROM audit")
def section_audit(spark, d):
    return _audit(spark, d)


@query(f"""WITH {_AUDIT} SELECT section_id, count(*) FILTER (WHERE verdict = 'ok') AS ok, count(*) FILTER (WHERE verdict = 'too_small') AS too_small, count(*) FILTER (WHERE verdict = 'too_large') AS too_large, count(*) FILTER (WHERE verdict = 'empty') AS empty, count(*) FILTER (WHERE verdict = 'missing') AS missing FROM audit GROUP BY 1""")
def audit_summary(spark, d):
    kinds = ["ok", "too_small", "too_large", "empty", "missing"]
    return _audit(spark, d).groupBy("section_id").pivot("verdict", kinds).agg(F.count(F.lit(1))).fillna(0, kinds)


@query(f"""WITH {_AUDIT} SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.section_id, b.section_id) AS section_id, coalesce(a.fiscal_year + 1, b.fiscal_year) AS fiscal_year, a.verdict AS before, b.verdict AS after,
 CASE WHEN a.verdict IS NULL THEN 'gained' WHEN b.verdict IS NULL THEN 'lost' WHEN a.verdict = b.verdict THEN 'same' ELSE 'shifted' END AS change
FROM audit a FULL JOIN audit b ON a.ticker = b.ticker AND a.section_id = b.section_id AND a.fiscal_year + 1 = b.fiscal_year""")
def audit_diff(spark, d):
    now = _audit(spark, d)
    return evaluate.compare_audits(now.withColumn("fiscal_year", F.col("fiscal_year") + 1), now, ["ticker", "section_id", "fiscal_year"], "verdict")


@query("""WITH i AS (SELECT DISTINCT outcome_id, ticker, fiscal_label FROM outcomes), h AS (SELECT DISTINCT ticker, fiscal_label FROM filings WHERE facts_built_at IS NOT NULL)
SELECT outcome_id, bool_and(coalesce(CASE WHEN i.fiscal_label IS NULL THEN i.ticker IN (SELECT ticker FROM h) ELSE h.ticker IS NOT NULL END, false)) AS covered FROM i LEFT JOIN h ON h.ticker = i.ticker AND h.fiscal_label = i.fiscal_label GROUP BY 1""")
def paired_subset(spark, d):
    i = table(spark, d, "outcomes").select("outcome_id", "ticker", "fiscal_label").distinct()
    return evaluate.all_required(i, "outcome_id", i, table(spark, d, "filings").filter("facts_built_at is not null"), ["ticker", "fiscal_label"])


_FIG = """fig AS (SELECT g.cik, g.y, trim(regexp_replace(f.concept, '^.*:', '')) AS concept, max(f.value::varchar::double) AS value FROM (SELECT accession, max(cik) AS cik, max(fiscal_label) AS y FROM filings GROUP BY 1) g JOIN facts f USING (accession) WHERE f.value IS NOT NULL AND f.concept IS NOT NULL AND g.cik IS NOT NULL AND g.y IS NOT NULL GROUP BY 1, 2, 3)"""


def _other_sql(key: str, kind: str) -> str:
    """Count, least and greatest of a key's other figures, from its two least and two greatest."""
    return f"SELECT fig.cik, fig.y, fig.concept, '{kind}' AS kind, k.n - 1 AS n, CASE WHEN fig.value = k.lo[1] THEN k.lo[2] ELSE k.lo[1] END AS least, CASE WHEN fig.value = k.hi[1] THEN k.hi[2] ELSE k.hi[1] END AS greatest FROM fig JOIN (SELECT {key}, concept, count(*) AS n, min(value, 2) AS lo, max(value, 2) AS hi FROM fig GROUP BY 1, 2) k ON k.{key} = fig.{key} AND k.concept = fig.concept WHERE k.n > 1"


@query(f"WITH {_FIG} {_other_sql('cik', 'wrong_period')} UNION ALL {_other_sql('y', 'wrong_entity')}")
def distractors(spark, d):
    """Distractors of every concept, whatever its prefix and outer blanks."""
    g = table(spark, d, "filings").groupBy("accession").agg(F.max("cik").alias("cik"), F.max("fiscal_label").alias("y")).filter("cik is not null and y is not null")
    f = table(spark, d, "facts").filter("value is not null and concept is not null").select("accession", local_name(F.col("concept")).alias("concept"), F.col("value").cast("double").alias("value"))
    fig = f.join(g, "accession").groupBy("cik", "y", "concept").agg(F.max("value").alias("value"))
    return evaluate.distractors(fig, "cik", "y", "concept", "value")


@query("""WITH t AS (SELECT DISTINCT id, citations, coalesce(status = 'abstained', false) AS refused, try_cast(nullif(regexp_extract(trim(as_of), '^(\\d{4}-\\d{2}-\\d{2})([T ].*)?$', 1), '') AS date) AS day FROM turns),
c AS (SELECT *, unnest(CASE WHEN json_valid(citations) THEN from_json(citations, '["JSON"]') END) AS c FROM t),
n AS (SELECT *, row_number() OVER () AS r FROM c),
f AS (SELECT id, citations, refused, day, list(try_cast(c->>'index' AS bigint) ORDER BY r) AS i, bool_or(coalesce(c->>'accession', '') = '' OR coalesce(c->>'filing_date', '') = '') AS blank, coalesce(bool_or(c->>'filing_date' > day::varchar), false) AS ahead FROM n GROUP BY ALL)
SELECT t.id, concat_ws(',', CASE WHEN i <> range(1, len(i) + 1) OR blank OR f.refused THEN 'citation_invalid' END, CASE WHEN ahead THEN 'look_ahead' END) AS flags
FROM t LEFT JOIN f ON f.id IS NOT DISTINCT FROM t.id AND f.citations = t.citations AND f.refused = t.refused AND f.day IS NOT DISTINCT FROM t.day""")
def citation_flags(spark, d):
    """All flags of every turn's citations."""
    t = table(spark, d, "turns").select("id", "citations", F.coalesce(F.col("status") == "abstained", F.lit(False)).alias("refused"), iso_day(F.col("as_of")).cast("string").alias("as_of")).distinct()
    listed = F.from_json("citations", evaluate.CITATIONS)
    return t.select("id", F.array_join(evaluate.citation_flags(listed, F.col("refused"), F.col("as_of")), ",").alias("flags"))


@query("""WITH g AS (SELECT item_id, unnest(list_filter([CASE WHEN trim(coalesce(question, '')) = '' THEN 'no question' END, CASE WHEN trim(coalesce(passage, '')) = '' THEN 'no passage' END, CASE WHEN category NOT IN ('numeric', 'computed', 'compare_trend', 'narrative', 'as_of', 'abstain') THEN 'unknown category' END,
 CASE WHEN verified_by NOT IN ('owner', 'companyfacts', 'auto') OR verified_by IS NULL THEN 'unknown verifier' END, CASE WHEN notes IS NULL THEN 'no notes' END], lambda x: x IS NOT NULL)) AS problem FROM gold_items) SELECT item_id, problem FROM g""")
def gold_problems(spark, d):
    g = table(spark, d, "gold_items")
    tests = F.array(
        F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "no question"), F.when(F.trim(F.coalesce("passage", F.lit(""))) == "", "no passage"), F.when(~F.col("category").isin("numeric", "computed", "compare_trend", "narrative", "as_of", "abstain"), "unknown category"),
        F.when(F.col("verified_by").isNull() | ~F.col("verified_by").isin("owner", "companyfacts", "auto"), "unknown verifier"), F.when(F.col("notes").isNull(), "no notes"),
    )
    return g.select("item_id", F.explode(F.array_compact(tests)).alias("problem"))


@query("""WITH o AS (SELECT outcome_id, query_type, status, row_number() OVER (PARTITION BY query_type, status ORDER BY md5('7:' || outcome_id::varchar), outcome_id) AS round FROM (SELECT DISTINCT outcome_id, query_type, status FROM outcomes))
SELECT outcome_id, query_type, status, round FROM o ORDER BY round, query_type NULLS FIRST, status NULLS FIRST LIMIT 200""")
def stratified_roundrobin(spark, d):
    o = table(spark, d, "outcomes").select("outcome_id", "query_type", "status").distinct()
    return evaluate.stratified(o, ["query_type", "status"], "outcome_id", 200)


@query("""WITH a AS (SELECT doc_id, section_id, ticker, row_number() OVER (PARTITION BY section_id, ticker ORDER BY doc_id) AS a, dense_rank() OVER (PARTITION BY section_id ORDER BY ticker) - 1 AS s, dense_rank() OVER (ORDER BY section_id) - 1 AS t FROM documents WHERE section_id IS NOT NULL AND ticker IS NOT NULL),
m AS (SELECT section_id, count(DISTINCT ticker) AS m FROM a GROUP BY 1), t AS (SELECT a.doc_id, a.section_id, row_number() OVER (PARTITION BY a.section_id ORDER BY a.a, (a.s - a.t + 100 * m.m) % m.m, a.doc_id) AS turn FROM a JOIN m USING (section_id)) SELECT * FROM t ORDER BY turn, section_id LIMIT 120""")
def topic_roundrobin(spark, d):
    docs = table(spark, d, "documents").filter("section_id is not null and ticker is not null").select("doc_id", "section_id", "ticker")
    return evaluate.round_robin(docs, "section_id", "ticker", "doc_id", 120).select("doc_id", "section_id", "turn")


@query("SELECT id, count(*) AS n FROM turns GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return table(spark, d, "turns").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT s.id, count(DISTINCT t.id) AS turns FROM sessions s LEFT JOIN turns t ON t.session_id = s.id GROUP BY 1")
def session_turn_counts(spark, d):
    t = table(spark, d, "turns").select("id", "session_id").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    return table(spark, d, "sessions").select("id").distinct().join(t, F.col("id") == F.col("session_id"), "left").select("id", F.coalesce("turns", F.lit(0)).alias("turns"))


@query("SELECT DISTINCT t.id, s.id AS session, t.is_correct FROM turns t JOIN (SELECT DISTINCT id FROM sessions) s ON t.session_id = s.id WHERE t.is_correct = 0")
def turn_review(spark, d):
    t = table(spark, d, "turns").filter("is_correct = 0").select("id", F.col("session_id").alias("session"), "is_correct").distinct()
    return t.join(table(spark, d, "sessions").select(F.col("id").alias("session")).distinct(), "session", "left_semi").select("id", "session", "is_correct")


@query("""WITH t AS (SELECT DISTINCT id, session_id, created_at FROM turns WHERE created_at IS NOT NULL AND session_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS back FROM t QUALIFY back <= 5)
SELECT session_id, string_agg(id, ',' ORDER BY back DESC) AS history FROM r GROUP BY 1""")
def history_last_n(spark, d):
    t = table(spark, d, "turns").select("id", "session_id", "created_at").distinct().filter("created_at is not null and session_id is not null")
    r = t.withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id")))).filter("back <= 5")
    return r.groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("back"), "id"))), lambda x: x.getField("id")), ",").alias("history"))


@query("""WITH l AS (SELECT session_id, max(created_at) AS last FROM turns GROUP BY 1), s AS (SELECT id, max(updated_at) AS updated_at FROM sessions GROUP BY 1), m AS (SELECT max(created_at) AS now FROM turns)
SELECT s.id FROM s LEFT JOIN l ON l.session_id = s.id, m WHERE greatest(coalesce(l.last, s.updated_at), coalesce(s.updated_at, l.last)) < m.now - INTERVAL 30 DAY""")
def stale_eviction(spark, d):
    """Sessions not touched, by a turn or an update, in the 30 days before the newest turn."""
    t = table(spark, d, "turns")
    s = table(spark, d, "sessions").groupBy("id").agg(F.max("updated_at").alias("updated_at"))
    last = t.groupBy("session_id").agg(F.max("created_at").alias("last"))
    now = t.agg(F.max("created_at").alias("now"))
    j = s.join(last, s["id"] == last["session_id"], "left").crossJoin(F.broadcast(now))  # one row
    return j.filter(F.greatest("last", "updated_at") < F.col("now") - F.expr("INTERVAL 30 DAYS")).select("id")


@query("""WITH done AS (SELECT DISTINCT turn_id FROM responses WHERE content IS NOT NULL AND content <> '') SELECT DISTINCT id FROM turns WHERE id NOT IN (SELECT turn_id FROM done)""")
def run_resume(spark, d):
    done = table(spark, d, "responses").filter("content is not null and content <> ''").select(F.col("turn_id").alias("id"))
    return table(spark, d, "turns").select("id").distinct().join(done, "id", "left_anti")


@query("""WITH f AS (SELECT ticker, fiscal_label, max(facts_built_at) AS b FROM filings GROUP BY 1, 2) SELECT ticker, fiscal_label, b IS NULL OR try_cast(b AS timestamp) < TIMESTAMP '2026-04-01 00:00:00' AS expired FROM f""")
def ttl_expiry(spark, d):
    f = table(spark, d, "filings").groupBy("ticker", "fiscal_label").agg(F.max("facts_built_at").alias("b"))
    return f.select("ticker", "fiscal_label", (F.col("b").isNull() | (F.col("b").try_cast("timestamp") < F.lit("2026-04-01 00:00:00").cast("timestamp"))).alias("expired"))


@query("SELECT DISTINCT outcome_id, status, CASE WHEN status = 'abstained' AND abstain_reason IS NULL THEN 'reason missing' WHEN status <> 'abstained' AND abstain_reason IS NOT NULL THEN 'reason given' WHEN status = 'error' AND error_code IS NULL THEN 'code missing' END AS violation FROM outcomes WHERE (status = 'abstained' AND abstain_reason IS NULL) OR (status <> 'abstained' AND abstain_reason IS NOT NULL) OR (status = 'error' AND error_code IS NULL)")
def outcome_violations(spark, d):
    s, r, e = F.col("status"), F.col("abstain_reason"), F.col("error_code")
    v = F.when((s == "abstained") & r.isNull(), "reason missing").when((s != "abstained") & r.isNotNull(), "reason given").when((s == "error") & e.isNull(), "code missing")
    return table(spark, d, "outcomes").select("outcome_id", "status", v.alias("violation")).filter("violation is not null").distinct()


@query("""SELECT DISTINCT outcome_id FROM outcomes o JOIN (SELECT cik, fiscal_label, min(filing_date) AS first FROM filings GROUP BY 1, 2) f USING (cik, fiscal_label)
WHERE status LIKE 'answered%' AND f.first > try_cast(nullif(regexp_extract(trim(as_of), '^(\\d{4}-\\d{2}-\\d{2})([T ].*)?$', 1), '') AS date)""")
def lookahead_refusals(spark, d):
    """Outcomes answered although no filing of the year was public on their day."""
    first = table(spark, d, "filings").groupBy("cik", "fiscal_label").agg(F.min("filing_date").alias("first"))
    o = table(spark, d, "outcomes").filter(F.col("status").startswith("answered")).select("outcome_id", "cik", "fiscal_label", iso_day(F.col("as_of")).alias("day"))
    return o.join(first, ["cik", "fiscal_label"]).filter("first > day").select("outcome_id").distinct()
