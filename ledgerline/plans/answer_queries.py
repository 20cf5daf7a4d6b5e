"""Queries over answers, entities and content blocks, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import answering, catalog
from ..runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _filled(text: str) -> str:
    t = text.replace("'", "''")
    for k, c in (("company", "ticker"), ("period", "fiscal_label::varchar"), ("as_of", "as_of")):
        t = t.replace("{" + k + "}", f"' || coalesce({c}, '?') || '")
    return f"'{t}'"


_CASES = " ".join(f"WHEN '{k}' THEN {_filled(v)}" for k, v in answering.MESSAGES.items())


@query(f"SELECT DISTINCT outcome_id, CASE abstain_reason {_CASES} END AS message FROM outcomes WHERE abstain_reason IS NOT NULL")
def abstain_messages(spark, d):
    o = table(spark, d, "outcomes").filter("abstain_reason is not null")
    return o.select("outcome_id", answering.message(F.col("abstain_reason"), F.col("ticker"), F.col("fiscal_label").cast("string"), F.col("as_of")).alias("message")).distinct()


@query("SELECT DISTINCT collection_name FROM filings WHERE collection_name IS NOT NULL AND filing_date <= DATE '2020-06-30' AND upper(form_type) NOT LIKE '%/A'")
def eligible_collections(spark, d):
    f = catalog.eligible(table(spark, d, "filings"), "2020-06-30").filter(~catalog.is_amendment(F.col("form_type")))
    return f.select("collection_name").filter("collection_name is not null").distinct()


@query("SELECT ticker, fiscal_year, doc_id, row_number() OVER (PARTITION BY ticker, fiscal_year ORDER BY doc_id) AS position FROM documents WHERE section_id = 'item_1a_risk_factors' QUALIFY position <= 5")
def section_scroll(spark, d):
    docs = table(spark, d, "documents").filter("section_id = 'item_1a_risk_factors'")
    return docs.select("ticker", "fiscal_year", "doc_id", F.row_number().over(Window.partitionBy("ticker", "fiscal_year").orderBy("doc_id")).alias("position")).filter("position <= 5")


@query("""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '\\n\\s*\\n')) AS p FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, trim(regexp_replace(p, '[ \\t]+', ' ', 'g'), ' ') AS p FROM p),
k AS (SELECT doc_id, length(p) AS n, CASE WHEN p LIKE '|%' THEN 'table' WHEN length(p) < 30 THEN NULL WHEN length(p) < 500 AND regexp_matches(p, '^[(*†‡§¶0-9]') THEN 'footnote' ELSE 'text' END AS kind FROM t)
SELECT doc_id, kind, count(*) AS blocks, sum(n)::bigint AS chars FROM k WHERE kind IS NOT NULL GROUP BY 1, 2""")
def content_blocks(spark, d):
    return answering.blocks(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("blocks"), F.sum("chars").alias("chars"))


_KEY = "trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[''’]s\\b', '', 'g'), '[^\\p{{L}}\\p{{N}}&]+', ' ', 'g'), ' +', ' ', 'g')), '^the ', ''), '( (inc|corp|corporation|co|company|ltd|plc|llc|group|holdings))+$', ''))"
_NORM = "' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower(query), '[''’]s\\b', '', 'g'), '[^\\p{L}\\p{N}&]+', ' ', 'g'), ' +', ' ', 'g')) || ' '"


@query(f"""WITH n AS (SELECT DISTINCT {_KEY.format(c='entity_name')} AS key FROM filings), q AS (SELECT DISTINCT outcome_id, {_NORM} AS q FROM outcomes WHERE query IS NOT NULL),
m AS (SELECT outcome_id, key FROM q JOIN n ON key <> '' AND contains(q, ' ' || key || ' '))
SELECT a.outcome_id, a.key FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.outcome_id = a.outcome_id AND length(b.key) > length(a.key) AND contains(' ' || b.key || ' ', ' ' || a.key || ' '))""")
def entity_mentions(spark, d):
    names = table(spark, d, "filings").select(answering.phrase_key(F.col("entity_name")).alias("key")).distinct()
    q = table(spark, d, "outcomes").select("outcome_id", "query").distinct()
    return answering.mentions(q, "outcome_id", "query", names, "key").select("outcome_id", "key").distinct()


@query(r"""WITH t AS (SELECT id, min(answer) AS a FROM turns WHERE answer IS NOT NULL GROUP BY 1), p AS (SELECT id, string_split_regex(a, '\[\d+\]') AS parts, regexp_extract_all(a, '\[(\d+)\]', 1) AS marks FROM t),
m AS (SELECT id, unnest(marks) AS mark, unnest(range(1, len(marks) + 1)) AS k FROM p), f AS (SELECT id, mark, row_number() OVER (PARTITION BY id ORDER BY min(k)) AS n FROM m GROUP BY 1, 2),
x AS (SELECT id, unnest(parts) AS part, unnest(range(0, len(parts))) AS k FROM p), y AS (SELECT x.id, x.k, x.part, f.n FROM x LEFT JOIN m ON m.id = x.id AND m.k = x.k LEFT JOIN f ON f.id = m.id AND f.mark = m.mark)
SELECT id, string_agg(CASE WHEN n IS NULL THEN part ELSE '[' || n::varchar || ']' || part END, '' ORDER BY k) AS text, count(DISTINCT n) AS cited FROM y GROUP BY 1""")
def citation_renumber(spark, d):
    """Every answer with its citations numbered in order of appearance, and how many it cites."""
    t = table(spark, d, "turns").filter("answer is not null").groupBy("id").agg(F.min("answer").alias("raw")).withColumn("text", answering.renumber(F.col("raw")))
    return t.select("id", "text", F.size(F.array_distinct(F.regexp_extract_all("raw", F.lit(r"\[(\d+)\]"), F.lit(1)))).alias("cited"))


@query("""WITH o AS (SELECT DISTINCT outcome_id, status, abstain_reason, fiscal_label FROM outcomes)
SELECT outcome_id, CASE WHEN status <> CASE WHEN fiscal_label > 2026 THEN 'abstained' ELSE status END THEN 'status' WHEN fiscal_label > 2026 AND abstain_reason IS DISTINCT FROM 'period_not_covered' THEN 'reason' ELSE 'pass' END AS verdict FROM o""")
def smoke_verdicts(spark, d):
    o = table(spark, d, "outcomes").select("outcome_id", "status", "abstain_reason", "fiscal_label").distinct()
    late = F.col("fiscal_label") > 2026
    return o.select("outcome_id", answering.smoke_verdict(F.when(late, "abstained").otherwise(F.col("status")), F.col("status"), F.when(late, "period_not_covered"), F.col("abstain_reason")).alias("verdict"))
