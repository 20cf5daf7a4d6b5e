"""Queries that score answers and runs, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numerals
from ..functions.text import iso_day
from ..operators import evaluate, scoring
from ..runtime import table
from .book import book
from .question_queries import _AUDIT, _audit, crosscheck_classify

QUERIES, SQL, query = book()


def _q(s: str) -> str:
    return s.replace("'", "''")


_FACTOR = "CASE w " + " ".join(f"WHEN '{k}' THEN {10**p}" for k, p in numerals.MAGNITUDE.items()) + " ELSE 1 END"


def numerals_sql(source: str) -> str:
    """CTEs ending in ``num`` (id, k, raw, value, step, pct, dg): the figures of ``source`` (id, t)."""
    return rf"""nm AS (SELECT id, regexp_extract_all(regexp_replace(coalesce(t, ''), '\[\d+\]|\d{{4}}-\d{{2}}-\d{{2}}', ' ', 'g'), '{_q(numerals.NUMERAL)}') AS raws FROM {source}),
n1 AS (SELECT id, unnest(raws) AS raw, unnest(range(1, len(raws) + 1)) AS k FROM nm),
n2 AS (SELECT id, k, raw, replace(regexp_extract(raw, '(\d[\d,]*(?:\.\d+)?)', 1), ',', '') AS dg, lower(regexp_extract(raw, '(?i)\d[\d,.]*\s*\)?\s*(trillion|billion|million|thousand|tn|bn|mm|[bmk])\b', 1)) AS w FROM n1),
num AS (SELECT id, k, trim(raw) AS raw, CASE WHEN regexp_matches(raw, '[-−–]\s*\d|[-−–]\s*[$€£]') OR (contains(raw, '(') AND contains(raw, ')')) THEN -1 ELSE 1 END * (dg::decimal(24,8) * ({_FACTOR})::decimal(13,0))::decimal(38,10) AS value,
  (CASE WHEN contains(dg, '.') THEN ('0.' || repeat('0', length(split_part(dg, '.', 2)) - 1) || '1') ELSE '1' END::decimal(20,10) * ({_FACTOR})::decimal(13,0))::decimal(38,10) AS step, regexp_matches(raw, '(?i)%|percent') AS pct FROM n2)"""


def verdict_sql(items: str, percent: str = "false", tol_rel: str = "0", tol_abs: str = "NULL") -> str:
    """CTE ``mv`` (id, e, verdict): ``match_value`` of ``num`` against ``items`` (id, e), without distractors."""
    digits = "regexp_replace(split_part(raw, 'e', 1), '[^0-9]', '', 'g')"
    return rf"""jn AS (SELECT i.id, i.e, n.*  EXCLUDE (id), i.e::varchar::double AS d, n.value::varchar::double AS v, n.step::varchar::double AS s FROM {items} i LEFT JOIN num n ON n.id = i.id),
jd AS (SELECT *, abs(value - e) * 2 <= step OR coalesce(abs(value - e) <= {tol_abs}, false) OR ({tol_rel} > 0 AND abs(v - d) <= {tol_rel} * abs(d)) AS ok, ({percent}) AND v <> 0 AND (abs(v * 100 - d) < 0.001 * abs(d) OR abs(v / 100 - d) < 0.001 * abs(d)) AS un,
  CASE WHEN v <> 0 AND d <> 0 THEN CASE WHEN abs(value + e) * 2 <= step THEN 'sign_error' WHEN (CASE WHEN length(regexp_replace({digits}, '^0+', '')) > 0 THEN length(regexp_replace({digits}, '^0+', '')) ELSE length({digits}) END) >= 2
    AND list_bool_or(list_transform([1e1, 1e-1, 1e2, 1e-2, 1e3, 1e-3, 1e4, 1e-4, 1e5, 1e-5, 1e6, 1e-6, 1e7, 1e-7, 1e8, 1e-8, 1e9, 1e-9, 1e10, 1e-10, 1e11, 1e-11, 1e12, 1e-12], lambda f: abs(v * f - d) <= s / 2 / abs(v) * abs(d))) THEN 'scale_error' END END AS df FROM jn),
mv AS (SELECT id, e, CASE WHEN count(k) = 0 THEN 'missing_number' WHEN coalesce(bool_or(ok), false) THEN 'correct' WHEN coalesce(bool_or(un), false) THEN 'unit_error' WHEN count(df) > 0 THEN arg_min(df, k) FILTER (WHERE df IS NOT NULL) ELSE 'wrong_value' END AS verdict FROM jd GROUP BY 1, 2)"""


@query(rf"WITH src AS (SELECT key AS id, content AS t FROM responses), {numerals_sql('src')} SELECT id AS key, k AS position, raw, value::varchar AS value, step::varchar AS step, pct AS is_percent FROM num")
def numeral_values(spark, d):
    """Every figure of every reply: its place, text, exact value, the step of its last digit, and whether it is a percentage."""
    n = table(spark, d, "responses").select("key", F.posexplode(numerals.numerals(F.col("content"))).alias("p", "n"))
    return n.select("key", (F.col("p") + 1).alias("position"), "n.raw", F.col("n.value").cast("string").alias("value"), F.col("n.step").cast("string").alias("step"), "n.is_percent")


_MILLIONS = r"USD (\d+(?:\.\d+)?) million"
_WANT = rf"""want AS (SELECT id AS turn_id, (try_cast(nullif(regexp_extract(min(answer), '{_MILLIONS}', 1), '') AS decimal(18,4)) * 1000000)::decimal(38,10) AS e FROM turns GROUP BY 1),
pairs AS (SELECT r.key AS id, r.content AS t, w.e, r.turn_id FROM responses r JOIN want w USING (turn_id) WHERE w.e IS NOT NULL)"""


def _pairs(spark, d):
    """Replies with the first figure in millions of dollars of their turn's answer as the expected one."""
    want = table(spark, d, "turns").groupBy(F.col("id").alias("turn_id")).agg(F.min("answer").alias("a"))
    want = want.select("turn_id", (F.nullif(F.regexp_extract("a", _MILLIONS, 1), F.lit("")).try_cast("decimal(18,4)") * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,10)").alias("e")).filter("e is not null")
    return table(spark, d, "responses").join(want, "turn_id")


@query(rf"WITH {_WANT}, {numerals_sql('pairs')}, {verdict_sql('pairs')} SELECT id AS key, verdict FROM mv")
def figure_verdicts(spark, d):
    """Verdict on every reply's figures against the expected one."""
    return _pairs(spark, d).select("key", scoring.match_value(F.col("content"), F.col("e")).alias("verdict"))


_VIEW = """vw AS (SELECT id AS turn_id, min(status) AS status, min(coalesce(is_correct, -1)) AS ok, min(as_of) AS as_of, min(abstain_reason) AS reason FROM turns GROUP BY 1)"""
_UNANSWERED = "WHEN status IN ('abstained', 'clarification_needed') THEN 'abstained_wrongly' WHEN status = 'error' THEN 'error' WHEN status IS NULL OR status NOT IN ('answered', 'answered_text') THEN 'not_run'"


def _answers(spark, d):
    """Replies as answers: the turn's status, and citations of the expected figure where the turn was marked correct, of another metric where it was marked wrong."""
    view = table(spark, d, "turns").groupBy(F.col("id").alias("turn_id")).agg(F.min("status").alias("status"), F.min(F.coalesce("is_correct", F.lit(-1))).alias("ok"), F.min("as_of").alias("as_of"), F.min("abstain_reason").alias("reason"))
    cite = F.struct(F.lit(1).cast("bigint").alias("index"), F.lit("fact").alias("kind"), F.when(F.col("ok") == 0, "assets").otherwise("revenue").alias("metric"), F.when(F.col("ok") == 1, F.col("e").cast("string")).alias("value"), F.lit("0000000001-20-000001").alias("accession"), F.lit("2020-02-01").alias("filing_date"), F.lit("").alias("section"))
    cites = F.when(F.col("ok") >= 0, F.array(cite)).otherwise(F.array().cast(scoring.CITATION))
    return _pairs(spark, d).join(view, "turn_id").withColumn("citations", cites.cast(scoring.CITATION)).withColumn("day", iso_day(F.col("as_of")).cast("string"))


_DAY = "try_cast(nullif(regexp_extract(trim(as_of), '^(\\d{4}-\\d{2}-\\d{2})([T ].*)?$', 1), '') AS date)"


def _flags(bad: str, bare: str) -> str:
    return f"concat_ws(',', CASE WHEN {bad} THEN 'citation_invalid' END, CASE WHEN ok >= 0 AND DATE '2020-02-01' > {_DAY} THEN 'look_ahead' END, CASE WHEN {bare} THEN 'uncited_number' END)"


@query(rf"""WITH {_WANT}, {numerals_sql('pairs')}, {verdict_sql('pairs')}, {_VIEW}, j AS (SELECT pairs.id, vw.*, mv.verdict AS m FROM pairs JOIN vw USING (turn_id) JOIN mv ON mv.id = pairs.id),
v AS (SELECT *, CASE {_UNANSWERED} WHEN ok = 1 THEN 'correct' WHEN ok = 0 THEN 'wrong_metric' WHEN m = 'correct' THEN 'correct_text_only' ELSE m END AS verdict FROM j)
SELECT id AS key, verdict, {_flags(bad="ok >= 0 AND status IN ('abstained', 'clarification_needed')", bare="verdict = 'correct_text_only'")} AS flags FROM v""")
def scored_numeric(spark, d):
    """Every reply scored as an answer to a question for one figure."""
    s = scoring.score_numeric(F.col("status"), F.col("content"), F.col("citations"), F.col("day"), F.col("e"), F.lit("revenue"))
    return _answers(spark, d).select("key", s.alias("s")).select("key", "s.verdict", F.array_join("s.flags", ",").alias("flags"))


@query(rf"""WITH {_WANT}, src AS (SELECT id, t FROM pairs), ex AS (SELECT id, e / 100 AS e FROM pairs), {numerals_sql('src')}, {verdict_sql('ex', 'true', '0.01', '0.5::decimal(38,10)')}, {_VIEW}, j AS (SELECT pairs.id, vw.*, mv.verdict AS m FROM pairs JOIN vw USING (turn_id) JOIN mv ON mv.id = pairs.id),
v AS (SELECT *, CASE {_UNANSWERED} ELSE m END AS verdict FROM j)
SELECT id AS key, verdict, {_flags(bad="ok >= 0 AND status IN ('abstained', 'clarification_needed')", bare="verdict = 'correct' AND ok <> 1")} AS flags FROM v""".replace("e / 100 AS e", "(e::varchar::double / 100)::decimal(38,10) AS e"))
def scored_computed(spark, d):
    """Every reply scored against a hundredth of the expected figure, as a percentage with tolerances."""
    e = (F.col("e").cast("double") / 100).cast("decimal(38,10)")
    s = scoring.score_computed(F.col("status"), F.col("content"), F.col("citations"), F.col("day"), e, F.lit(True), F.lit(0.01), F.lit(0.5).cast("decimal(38,10)"))
    return _answers(spark, d).select("key", s.alias("s")).select("key", "s.verdict", F.array_join("s.flags", ",").alias("flags"))


@query(rf"""WITH w AS (SELECT id AS turn_id, list_distinct(list_transform(regexp_extract_all(min(answer), '{_MILLIONS}', 1), lambda x: (x::decimal(18,4) * 1000000)::decimal(38,10))) AS es FROM turns GROUP BY 1),
r AS (SELECT key, content AS t, turn_id, es FROM responses JOIN w USING (turn_id) WHERE len(es) > 0), x AS (SELECT key || '|' || unnest(es)::varchar AS id, key, t, unnest(es) AS e, turn_id FROM r), {numerals_sql('x')}, {verdict_sql('x')}, {_VIEW},
g AS (SELECT x.key, x.turn_id, count(*) FILTER (WHERE mv.verdict = 'correct') AS correct, count(*) AS expected FROM x JOIN mv ON mv.id = x.id GROUP BY 1, 2)
SELECT key, CASE {_UNANSWERED} WHEN correct = expected THEN 'correct' WHEN correct > 0 THEN 'partial_multi' ELSE 'wrong_value' END AS verdict, correct, expected FROM g JOIN vw USING (turn_id)""")
def scored_multi(spark, d):
    """Every reply scored against all figures in millions of dollars of its turn's answer."""
    w = table(spark, d, "turns").groupBy(F.col("id").alias("turn_id")).agg(F.min("answer").alias("a"), F.min("status").alias("status"), F.min("as_of").alias("as_of"))
    es = F.array_distinct(F.transform(F.regexp_extract_all("a", F.lit(_MILLIONS), F.lit(1)), lambda x: (x.cast("decimal(18,4)") * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,10)")))
    r = table(spark, d, "responses").join(w.withColumn("es", es).filter(F.size("es") > 0), "turn_id")
    answers = r.select("key", "status", F.col("content").alias("answer"), F.array().cast(scoring.CITATION).alias("citations"), iso_day(F.col("as_of")).cast("string").alias("as_of"))
    values = r.select("key", F.explode("es").alias("value")).select("key", F.col("value").cast("string").alias("label"), "value")
    return scoring.score_multi(answers, "key", values).select("key", "verdict", "correct", "expected")


_FIGURE = r"(?i)(?:^|[^\w.])(?:[$€£]\s*\d|\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?\s*%|\d+(?:\.\d+)?\s*(?:percent|trillion|billion|million|thousand)\b)"


@query(rf"""WITH t AS (SELECT id, min(answer) AS answer, min(status) AS status, min(abstain_reason) AS reason FROM turns GROUP BY 1)
SELECT id, CASE WHEN status IS NULL THEN 'not_run' WHEN status = 'error' THEN 'error' WHEN status IN ('answered', 'answered_text') THEN 'answered_wrongly' WHEN reason IS NOT DISTINCT FROM 'period_not_covered' THEN 'correct_abstain' ELSE 'wrong_abstain_reason' END AS verdict,
 coalesce(status NOT IN ('answered', 'answered_text', 'error') AND regexp_matches(coalesce(answer, ''), '{_FIGURE}'), false) AS with_number FROM t""")
def scored_abstain(spark, d):
    """Every turn scored as one that should have been refused for lack of coverage."""
    t = table(spark, d, "turns").groupBy("id").agg(F.min("answer").alias("answer"), F.min("status").alias("status"), F.min("abstain_reason").alias("reason"))
    s = scoring.score_abstain(F.col("status"), F.col("answer"), F.array().cast(scoring.CITATION), F.lit(None).cast("string"), F.col("reason"), F.lit("period_not_covered"), F.lit(False))
    return t.select("id", s.alias("s")).select("id", "s.verdict", F.array_contains("s.flags", "abstention_with_number").alias("with_number"))


@query(rf"SELECT id, coalesce(regexp_matches(min(answer), '{_FIGURE}'), false) AS states_a_figure FROM turns WHERE status = 'abstained' GROUP BY 1")
def refusal_figures(spark, d):
    """Whether a refusal states a quantity."""
    return table(spark, d, "turns").filter("status = 'abstained'").groupBy("id").agg(F.min("answer").alias("a")).select("id", scoring.states_a_figure(F.col("a")).alias("states_a_figure"))


_LATE = "lower(replace(replace(section_id, 'item_1a_risk_factors', 'Item 1A: Risk Factors'), 'item_7_mda', 'item_7_mda__2'))"


@query("""WITH c AS (SELECT ticker, fiscal_year, section_id, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY doc_id) AS rank FROM documents WHERE ticker IS NOT NULL AND fiscal_year IS NOT NULL AND section_id IS NOT NULL QUALIFY rank <= 5),
k AS (SELECT DISTINCT ticker, fiscal_year FROM c) SELECT k.ticker, k.fiscal_year, CASE WHEN min(rank) FILTER (WHERE section_id IN ('item_7_mda', 'item_1a_risk_factors')) IS NULL THEN 'wrong_value' ELSE 'correct' END AS verdict, min(rank) FILTER (WHERE section_id IN ('item_7_mda', 'item_1a_risk_factors')) AS rank FROM k JOIN c USING (ticker, fiscal_year) GROUP BY 1, 2""")
def scored_text(spark, d):
    """Each filing's first five passages as the citations of an answer that should rest on its risk factors or its discussion, in three spellings of a section."""
    docs = table(spark, d, "documents").filter("ticker is not null and fiscal_year is not null and section_id is not null")
    shown = F.when(F.col("section_id") == "item_1a_risk_factors", "Item 1A: Risk Factors").when(F.col("section_id") == "item_7_mda", "item_7_mda__2").otherwise(F.col("section_id"))
    from ..operators.retrieval import top

    first = top(docs.select("ticker", "fiscal_year", "doc_id", shown.alias("section")), ["ticker", "fiscal_year"], [F.col("doc_id")], 5)
    g = first.groupBy("ticker", "fiscal_year").agg(F.sort_array(F.collect_list(F.struct("rank", "section"))).alias("c"))
    none = F.lit("").alias
    cites = F.transform("c", lambda x: F.struct(x.getField("rank").cast("bigint").alias("index"), F.lit("text").alias("kind"), none("metric"), none("value"), none("accession"), none("filing_date"), x.getField("section").alias("section"))).cast(scoring.CITATION)
    wanted = F.array(F.lit("item_7_mda"), F.lit("item_1a_risk_factors__3"))
    s = scoring.score_text(F.lit("answered"), F.lit(""), cites, F.lit(None).cast("string"), wanted, F.lit(None).cast("array<string>"))
    return g.select("ticker", "fiscal_year", s.getField("verdict").alias("verdict"), scoring.section_rank(F.transform("c", lambda x: x.getField("section")), wanted).alias("rank"))


_SCORED_SQL = SQL["scored_numeric"]


@query(f"WITH s AS ({_SCORED_SQL}), c AS (SELECT r.provider AS category, s.verdict FROM s JOIN responses r USING (key)) SELECT category, verdict, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY grouping(category), category), 6) AS share FROM c GROUP BY GROUPING SETS ((category, verdict), (verdict))")
def verdict_totals(spark, d):
    s = scored_numeric(spark, d).join(table(spark, d, "responses").select("key", F.col("provider").alias("category")), "key")
    return scoring.verdict_totals(s, "category")


@query(f"WITH s AS ({_SCORED_SQL}) SELECT flag, count(*) AS n FROM (SELECT key, unnest(string_split(flags, ',')) AS flag FROM s WHERE flags <> '') GROUP BY 1")
def flag_totals(spark, d):
    return scoring.flag_totals(scored_numeric(spark, d).filter("flags <> ''").withColumn("f", F.split("flags", ",")), "f")


@query("""WITH l AS (SELECT turn_id AS id, arg_max(CASE WHEN content IS NULL THEN 'empty' ELSE 'answered' END, (created_at, CASE WHEN content IS NULL THEN 'empty' ELSE 'answered' END)) AS s FROM responses WHERE turn_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1)
SELECT t.id, coalesce(l.s, 'not_run') AS run_status FROM (SELECT DISTINCT id FROM turns) t LEFT JOIN l USING (id)""")
def run_join(spark, d):
    runs = table(spark, d, "responses").filter("created_at is not null").select(F.col("turn_id").alias("id"), F.col("created_at").alias("at"), F.when(F.col("content").isNull(), "empty").otherwise("answered").alias("status"))
    return scoring.run_join(table(spark, d, "turns").select("id").distinct(), runs, "id")


@query("""WITH g AS (SELECT DISTINCT accession, concept, end_date, value FROM facts WHERE value IS NOT NULL AND decimals = 'INF' AND end_date IS NOT NULL AND concept IS NOT NULL), o AS (SELECT DISTINCT accession, concept, end_date, value AS o FROM facts WHERE value IS NOT NULL AND decimals = '-3' AND end_date IS NOT NULL AND concept IS NOT NULL)
SELECT g.accession, g.concept, g.end_date, g.value::varchar AS value, CASE WHEN count(o) = 0 THEN 'auto' WHEN bool_or(o = value) THEN 'companyfacts' ELSE 'mismatch' END AS verified_by FROM g LEFT JOIN o USING (accession, concept, end_date) GROUP BY g.accession, g.concept, g.end_date, g.value""")
def gold_oracle(spark, d):
    """Exact figures verified by those stated in thousands."""
    f = table(spark, d, "facts").filter("value is not null and end_date is not null and concept is not null")
    keys = ["accession", "concept", "end_date"]
    return scoring.gold_oracle(f.filter("decimals = 'INF'").select(*keys, "value").distinct(), f.filter("decimals = '-3'").select(*keys, "value"), keys).withColumn("value", F.col("value").cast("string"))


@query("""WITH s AS (SELECT item_id, CASE verified_by WHEN 'owner' THEN ' ok' WHEN 'auto' THEN 'WRONG' END AS verdict FROM gold_items UNION ALL SELECT item_id + 1000000, 'OK' FROM gold_items WHERE verified_by = 'owner')
SELECT s.item_id, CASE WHEN g.item_id IS NULL THEN 'unknown_id' WHEN upper(trim(verdict)) = 'WRONG' THEN 'wrong' WHEN upper(trim(verdict)) = 'OK' THEN 'owner' ELSE 'unsigned' END AS outcome FROM s LEFT JOIN gold_items g USING (item_id)""")
def sheet_apply(spark, d):
    g = table(spark, d, "gold_items").select("item_id", "verified_by")
    sheet = g.select("item_id", F.when(F.col("verified_by") == "owner", " ok").when(F.col("verified_by") == "auto", "WRONG").alias("verdict"))
    return scoring.apply_sheet(g, sheet.unionByName(g.filter("verified_by = 'owner'").select((F.col("item_id") + 1000000).alias("item_id"), F.lit("OK").alias("verdict"))), "item_id")


@query(f"""WITH {_AUDIT}, w AS (SELECT DISTINCT outcome_id, ticker, fiscal_label AS fiscal_year, unnest(['item_7_mda', 'item_1a_risk_factors', 'fs_notes']) AS section_id FROM outcomes WHERE query_type = 'narrative'),
j AS (SELECT w.outcome_id, w.section_id, coalesce(a.verdict, 'missing') AS v FROM w LEFT JOIN audit a ON a.ticker = w.ticker AND a.fiscal_year = w.fiscal_year AND a.section_id = w.section_id)
SELECT outcome_id, count(*) FILTER (WHERE v <> 'ok') = 0 AS ready, coalesce(string_agg(DISTINCT section_id || ':' || v, ',' ORDER BY section_id || ':' || v) FILTER (WHERE v <> 'ok'), '') AS problems FROM j GROUP BY 1""")
def sections_ready(spark, d):
    items = table(spark, d, "outcomes").filter("query_type = 'narrative'").select("outcome_id", "ticker", F.col("fiscal_label").alias("fiscal_year")).distinct().withColumn("sections", F.array(F.lit("item_7_mda"), F.lit("item_1a_risk_factors"), F.lit("fs_notes")))
    return scoring.sections_ready(items, "outcome_id", "sections", ["ticker", "fiscal_year"], _audit(spark, d))


def _crosscheck_sql() -> str:
    from . import question_queries

    return question_queries.SQL["crosscheck_classify"]


@query(f"WITH c AS ({_crosscheck_sql()}) SELECT count(*) FILTER (WHERE verdict <> 'not_in_oracle') AS comparable, count(*) FILTER (WHERE verdict = 'exact') AS exact, round(count(*) FILTER (WHERE verdict = 'exact') / count(*) FILTER (WHERE verdict <> 'not_in_oracle'), 6) AS rate FROM c")
def exact_rate(spark, d):
    return scoring.exact_rate(crosscheck_classify(spark, d), "verdict")


_ARMS = """arms AS (SELECT model AS arm, avg(CASE WHEN content IS NULL OR content = '' THEN 0.0 ELSE 1.0 END)::double AS hit_rate, avg(1.0 / nullif(completion_tokens, 0))::double AS mrr, avg(prompt_tokens)::double AS seconds FROM responses GROUP BY 1), b AS (SELECT * FROM arms WHERE arm = (SELECT min(model) FROM responses))"""


@query(f"WITH {_ARMS} SELECT arms.arm, coalesce(b.hit_rate - arms.hit_rate <= 0.05 AND b.mrr - arms.mrr <= 0.03 AND b.seconds >= 0.5 * arms.seconds, false) AS accepted FROM arms, b")
def arm_decision(spark, d):
    """Which models may stand in for the first by name, with cost in prompt tokens."""
    r = table(spark, d, "responses")
    arms = r.groupBy(F.col("model").alias("arm")).agg(F.avg(F.when(F.coalesce("content", F.lit("")) == "", 0.0).otherwise(1.0)).alias("hit_rate"), F.avg(1.0 / F.nullif("completion_tokens", F.lit(0))).alias("mrr"), F.avg("prompt_tokens").alias("seconds"))
    return scoring.arm_decision(arms, r.agg(F.min("model")).first()[0], faster=0.5)


@query("""WITH r AS (SELECT provider, completion_tokens AS v, row_number() OVER (PARTITION BY provider ORDER BY completion_tokens) AS k, count(*) OVER (PARTITION BY provider) AS n FROM responses WHERE completion_tokens IS NOT NULL)
SELECT provider, max(v) FILTER (WHERE k - 1 = least(n - 1, trunc(n * 0.95)::int)) AS p95, max(v) AS most FROM r GROUP BY 1""")
def smoke_percentile(spark, d):
    """The other percentile: the element at the whole part of n x 0.95, and the greatest."""
    r = table(spark, d, "responses")
    p = evaluate.floor_rank(r, ["provider"], "completion_tokens", 0.95, "p95")
    return p.join(r.groupBy("provider").agg(F.max("completion_tokens").alias("most")), "provider")


@query("SELECT provider, prompt_version AS role, count(*) AS calls, sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0))::bigint AS tokens, round(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) / sum(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0))) OVER (PARTITION BY provider), 6) AS share FROM responses GROUP BY 1, 2")
def role_totals(spark, d):
    """Calls and tokens by role within a provider; the prompt's version stands for the role."""
    return evaluate.role_totals(table(spark, d, "responses"), "provider", "prompt_version", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))


@query("SELECT model, round(avg(prompt_tokens), 6) AS prompt_tokens, round(avg(completion_tokens), 6) AS completion_tokens, count(*) AS n FROM responses GROUP BY 1")
def metric_means(spark, d):
    return evaluate.metric_means(table(spark, d, "responses"), "model", ["prompt_tokens", "completion_tokens"])
