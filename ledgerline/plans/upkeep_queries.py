"""Queries on the upkeep of stores and of search collections, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import iso_day
from ..operators import answering, catalog, evaluate, upkeep
from ..runtime import table
from ..sources import files
from .book import book
from .filing_queries import _F, _filings

QUERIES, SQL, query = book()
DAY = "2020-06-30"


@query(f"""WITH {_F} SELECT accession, CASE WHEN filing_date >= DATE '{DAY}' THEN year(period_end) ELSE fiscal_label END AS fiscal_label, CASE WHEN filing_date >= DATE '{DAY}' THEN 'dei' ELSE fiscal_label_source END AS fiscal_label_source, CASE WHEN filing_date >= DATE '{DAY}' THEN NULL ELSE collection_name END AS collection_name, facts_built_at FROM f""")
def catalog_keyed_updates(spark, d):
    """Label, its source and the collection link of every late filing set by key."""
    f = _filings(spark, d)
    late = f.filter(F.col("filing_date") >= F.lit(DAY).cast("date")).select("accession", F.year("period_end").alias("fiscal_label"), F.lit("dei").alias("fiscal_label_source"), F.lit(None).cast("string").alias("collection_name"))
    return upkeep.update_by_key(f, late, "accession").select("accession", "fiscal_label", "fiscal_label_source", "collection_name", "facts_built_at")


@query("SELECT id, accession FROM facts WHERE accession NOT IN (SELECT accession FROM filings WHERE upper(form_type) LIKE '%/A')")
def facts_forget(spark, d):
    gone = table(spark, d, "filings").filter(catalog.is_amendment(F.col("form_type")))
    return upkeep.forget(table(spark, d, "facts").select("id", "accession"), gone, "accession")


@query("SELECT s.id, coalesce(t.last, s.updated_at) AS updated_at FROM (SELECT DISTINCT * FROM sessions) s LEFT JOIN (SELECT session_id, max(created_at) AS last FROM turns WHERE created_at IS NOT NULL GROUP BY 1) t ON t.session_id = s.id")
def chat_touch(spark, d):
    s = upkeep.touch_sessions(table(spark, d, "sessions").distinct(), table(spark, d, "turns"))
    return s.select("id", "updated_at")


@query("SELECT id, count(*) AS n FROM (SELECT id FROM turns WHERE status = 'answered' UNION ALL SELECT DISTINCT id FROM turns WHERE id IS NOT NULL AND id NOT IN (SELECT id FROM turns WHERE status = 'answered' AND id IS NOT NULL)) GROUP BY 1")
def chat_append(spark, d):
    """All turns appended to the answered ones: each new id once, stored rows untouched."""
    t = table(spark, d, "turns")
    return upkeep.append_turns(t.filter("status = 'answered'"), t).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT item_id, category, question, notes FROM gold_items), n AS (SELECT item_id, category, question, coalesce(notes, 'held out') AS notes FROM gold_items WHERE category <> 'abstain' UNION ALL SELECT item_id + 1000000, category, question, notes FROM gold_items WHERE category = 'numeric')
SELECT coalesce(o.item_id, n.item_id) AS item_id, CASE WHEN o.item_id IS NULL THEN 'only_new' WHEN n.item_id IS NULL THEN 'only_old' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.item_id = n.item_id
WHERE o.item_id IS NULL OR n.item_id IS NULL OR o.category IS DISTINCT FROM n.category OR o.question IS DISTINCT FROM n.question OR o.notes IS DISTINCT FROM n.notes""")
def gold_rebuild(spark, d):
    old = table(spark, d, "gold_items").select("item_id", "category", "question", "notes")
    new = old.filter("category <> 'abstain'").withColumn("notes", F.coalesce("notes", F.lit("held out"))).unionByName(old.filter("category = 'numeric'").withColumn("item_id", F.col("item_id") + 1000000))
    return upkeep.rebuild_check(old, new, "item_id")


@query("SELECT DISTINCT outcome_id FROM outcomes WHERE outcome_id NOT IN (SELECT outcome_id FROM outcomes WHERE status = 'error')")
def frozen_subset(spark, d):
    o = table(spark, d, "outcomes")
    return upkeep.frozen_subset(o, o.filter("status = 'error'"), "outcome_id")


@query(f"SELECT DISTINCT collection_name FROM filings WHERE collection_name IS NOT NULL AND (collection_name, accession) NOT IN (SELECT collection_name, accession FROM filings WHERE collection_name IS NOT NULL AND filing_date < DATE '{DAY}')")
def stale_collections(spark, d):
    f = table(spark, d, "filings").filter("collection_name is not null")
    return upkeep.stale_collections(f, f.filter(F.col("filing_date") < F.lit(DAY).cast("date")), "collection_name", "accession")


@query("SELECT DISTINCT a.ticker, b.accession FROM (SELECT DISTINCT ticker, cik FROM filings) a JOIN filings b ON a.cik = b.cik")
def ticker_filings(spark, d):
    f = table(spark, d, "filings")
    return upkeep.filings_of_tickers(f, f)


_PICK = {"both": (["UMBT", "PYJXB"], [2018, 2019, 2020]), "tickers": (["UMBT", "PYJXB"], []), "years": ([], [2018, 2019, 2020]), "all": ([], [])}


@query("""WITH c AS (SELECT DISTINCT collection_name, upper(regexp_extract(collection_name, '^(.*)_[^_]*$', 1)) IN ('UMBT', 'PYJXB') AS t, coalesce(try_cast(regexp_extract(collection_name, '_(\\d+)$', 1) AS int) IN (2018, 2019, 2020), false) AS y FROM filings WHERE collection_name IS NOT NULL)
SELECT 'both' AS asked, collection_name FROM c WHERE t AND y UNION ALL SELECT 'tickers', collection_name FROM c WHERE t UNION ALL SELECT 'years', collection_name FROM c WHERE y UNION ALL SELECT 'all', collection_name FROM c""")
def target_collections(spark, d):
    """Collections asked for by ticker and year, by either, and all."""
    c = table(spark, d, "filings").select("collection_name").filter("collection_name is not null")
    out = None
    for name, (tickers, years) in _PICK.items():
        part = upkeep.target_collections(c, tickers, years).select(F.lit(name).alias("asked"), "collection_name")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_F} SELECT collection_name, arg_max(ticker, (period_end, filing_date, accession)) AS ticker, arg_max(accession, (period_end, filing_date, accession)) AS accession, arg_max(fiscal_label, (period_end, filing_date, accession)) AS fiscal_label, arg_max(filing_date, (period_end, filing_date, accession)) AS filing_date FROM f WHERE collection_name IS NOT NULL AND filing_date <= DATE '{DAY}' AND fiscal_label IN (2017, 2018, 2019) GROUP BY 1")
def collection_filings(spark, d):
    return upkeep.collections_with_filing(_filings(spark, d), DAY, [2017, 2018, 2019])


_WORDS = " OR ".join(f"contains(s, '{w.replace(chr(39), chr(39) * 2)}')" for w in upkeep.PRIORITY)


@query(f"""WITH c AS (SELECT doc_id, ticker, fiscal_year, lower(replace(coalesce(section_id, ''), '_', ' ')) AS s FROM documents WHERE ticker IS NOT NULL AND fiscal_year IS NOT NULL), h AS (SELECT *, {_WORDS} AS hit FROM c)
SELECT doc_id, count(*) OVER w < 40 OR NOT bool_or(hit) OVER w OR hit AS first FROM h WINDOW w AS (PARTITION BY ticker)""")
def priority_split(spark, d):
    c = table(spark, d, "documents").filter("ticker is not null and fiscal_year is not null").select("doc_id", "ticker", F.replace(F.coalesce("section_id", F.lit("")), F.lit("_"), F.lit(" ")).alias("s"))
    return upkeep.priority_chunks(c, ["ticker"], "s").select("doc_id", "first")


@query(f"""WITH c AS (SELECT ticker || '_' || fiscal_label::varchar AS file, cik::varchar AS doc, filing_date AS written FROM filings WHERE filing_date >= DATE '2016-01-01'), p AS (SELECT ticker || '_' || fiscal_label::varchar AS file, min(cik)::varchar AS expected, max(period_end) + 200 AS parsed FROM filings GROUP BY 1),
h AS (SELECT file, min(doc) AS lo, max(doc) AS hi, count(*) FILTER (WHERE doc IS NULL) AS n, min(written) AS w FROM c GROUP BY 1) SELECT p.file, coalesce(lo = expected AND hi = expected AND n = 0 AND (parsed IS NULL OR w >= parsed), false) AS current FROM p LEFT JOIN h USING (file)""")
def chunk_currency(spark, d):
    f = table(spark, d, "filings").withColumn("file", F.concat_ws("_", "ticker", F.col("fiscal_label").cast("string")))
    chunks = f.filter("filing_date >= date'2016-01-01'").select("file", F.col("cik").cast("string").alias("doc"), F.col("filing_date").alias("written"))
    parses = f.groupBy("file").agg(F.min("cik").cast("string").alias("expected"), F.date_add(F.max("period_end"), 200).alias("parsed"))
    return upkeep.current_files(chunks, "file", "doc", parses)


@query("""WITH e AS (SELECT DISTINCT accession, unnest(list_append(exhibit_docs, primary_doc)) AS name FROM filings), s AS (SELECT accession, name, length(name) * 120 AS size FROM e WHERE name IS NOT NULL),
g AS (SELECT *, lower(name) IN ('primary-document.html', 'primary-document.htm') AS named, regexp_matches(lower(name), '\\.html?$') AND NOT contains(lower(name), 'index') AS page FROM s)
SELECT accession, arg_min(name, (CASE WHEN named THEN 0 ELSE 1 END, CASE WHEN named THEN 0 ELSE -size END, name)) FILTER (WHERE size > 1000 AND (named OR page)) AS name FROM g GROUP BY 1""")
def primary_documents(spark, d):
    """The primary document of every filing among its own and its exhibits; sizes stand in for bytes."""
    docs = table(spark, d, "filings").select("accession", F.explode(F.array_append("exhibit_docs", F.col("primary_doc"))).alias("name")).distinct().filter("name is not null")
    return upkeep.primary_documents(docs.withColumn("size", F.length("name") * 120))


@query("""WITH r AS (SELECT coalesce(source, '') AS source, sha256(concat_ws(chr(31), doc_id::varchar, coalesce(n_chars, 0)::varchar, coalesce(text, ''))) AS r FROM documents),
b AS (SELECT source, substr(r, 1, 4) AS b, count(*) AS n, sha256(string_agg(r, chr(30) ORDER BY r)) AS h FROM r GROUP BY 1, 2) SELECT source, sum(n)::bigint AS rows, sha256(string_agg(b || h, chr(30) ORDER BY b || h)) AS hash FROM b GROUP BY 1""")
def source_fingerprint(spark, d):
    """Order-free hash of every source's whole documents, and their number."""
    docs = table(spark, d, "documents").withColumn("source", F.coalesce("source", F.lit("")))
    return upkeep.fingerprint(docs, ["source"], F.concat_ws("\u001f", F.col("doc_id").cast("string"), F.coalesce("n_chars", F.lit(0)).cast("string"), F.coalesce("text", F.lit(""))))


@query("SELECT model, count(*) AS n, sum(completion_tokens)::bigint AS tokens, round(max(created_at) - min(created_at), 3) AS seconds, round(count(*)::double / nullif(max(created_at) - min(created_at), 0), 6) AS rate FROM responses GROUP BY 1")
def run_totals(spark, d):
    return upkeep.run_totals(table(spark, d, "responses"), "model", "created_at", "completion_tokens").withColumn("seconds", F.round("seconds", 3))


@query("WITH c AS (SELECT section_id, count(*) AS n FROM documents WHERE section_id IS NOT NULL GROUP BY 1) SELECT section_id, n FROM c ORDER BY n, section_id")
def smallest_first(spark, d):
    return upkeep.smallest_first(table(spark, d, "documents").filter("section_id is not null").groupBy("section_id").agg(F.count(F.lit(1)).alias("n")), "section_id")


@query("SELECT doc_id FROM documents ORDER BY md5('11:' || doc_id::varchar), doc_id LIMIT 50")
def seeded_sample(spark, d):
    return upkeep.seeded_sample(table(spark, d, "documents").select("doc_id"), "doc_id", 50, 11)


@query("SELECT section_id, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars FROM documents WHERE section_id IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1")
def best_hit(spark, d):
    docs = table(spark, d, "documents").filter("section_id is not null").select("section_id", "doc_id", "n_chars")
    return upkeep.best_hit(docs, ["section_id"], "n_chars", "doc_id").select("section_id", "doc_id", "n_chars")


@query("WITH c(category) AS (VALUES ('numeric'), ('computed'), ('compare_trend'), ('narrative'), ('as_of'), ('abstain'), ('unused')) SELECT c.category, count(g.item_id) AS n FROM c LEFT JOIN gold_items g USING (category) GROUP BY 1")
def category_counts(spark, d):
    return upkeep.zero_filled(table(spark, d, "gold_items"), "category", ("numeric", "computed", "compare_trend", "narrative", "as_of", "abstain", "unused"))


_UP = "n AS (SELECT source, doc_id, -n_chars AS n_chars FROM documents WHERE section_id = 'notes' UNION ALL SELECT source, doc_id + 1000000000, n_chars FROM documents WHERE section_id = 'notes')"


@query(f"WITH {_UP} SELECT source, doc_id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.source IS NOT DISTINCT FROM d.source AND n.doc_id = d.doc_id) UNION ALL SELECT source, doc_id, n_chars FROM n")
def collections_upsert(spark, d):
    """Chunks of every source written over their stored namesakes and beside the others."""
    stored = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    notes = table(spark, d, "documents").filter("section_id = 'notes'").select("source", "doc_id", "n_chars")
    incoming = notes.withColumn("n_chars", -F.col("n_chars")).unionByName(notes.withColumn("doc_id", F.col("doc_id") + 1000000000))
    return files.merge_collections(stored, incoming, "doc_id", "source", ["n_chars"])


@query("""WITH s AS (SELECT coalesce(lang, '?') AS lang, doc_id FROM documents), t AS (SELECT * FROM s WHERE doc_id IN (SELECT doc_id FROM documents WHERE section_id IS NOT NULL)), o AS (SELECT a.lang FROM (SELECT lang, count(*) AS n FROM s GROUP BY 1) a LEFT JOIN (SELECT lang, count(*) AS n FROM t GROUP BY 1) b USING (lang) WHERE b.n IS NULL OR a.n <> b.n)
SELECT lang, doc_id FROM s WHERE lang IN (SELECT lang FROM o) AND doc_id NOT IN (SELECT doc_id FROM t)""")
def copy_resume(spark, d):
    """What a copy by language still has to write."""
    docs = table(spark, d, "documents").select(F.coalesce("lang", F.lit("?")).alias("lang"), "doc_id", "section_id")
    return files.copy_collections(docs.select("lang", "doc_id"), docs.filter("section_id is not null").select("lang", "doc_id"), "doc_id", "lang")


@query("""WITH p AS (SELECT doc_id, coalesce(source, '') AS source, unnest(string_split_regex(text, '\\n\\s*\\n')) AS p FROM documents WHERE text IS NOT NULL), t AS (SELECT source, trim(regexp_replace(p, '[ \\t]+', ' ', 'g'), ' ') AS p FROM p),
k AS (SELECT source, length(p) AS n, CASE WHEN p LIKE '|%' THEN 'table' WHEN length(p) < 30 THEN NULL WHEN length(p) < 500 AND regexp_matches(p, '^[(*†‡§¶0-9]') THEN 'footnote' ELSE 'text' END AS kind FROM t)
SELECT source, count(*) FILTER (WHERE kind = 'text') AS text, count(*) FILTER (WHERE kind = 'table') AS "table", count(*) FILTER (WHERE kind = 'footnote') AS footnote, sum(n)::bigint AS chars FROM k WHERE kind IS NOT NULL GROUP BY 1""")
def chunk_stats(spark, d):
    """Blocks of every source by kind, and their characters."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"))
    b = answering.blocks(docs.select(F.struct("source", "doc_id").alias("key"), "text"), "key", "text").select("key.source", "kind", "chars")
    return b.groupBy("source").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("text", "table", "footnote")], F.sum("chars").alias("chars"))


@query("""WITH b(session_id) AS (SELECT id FROM sessions WHERE title IS NULL OR trim(title) = ''), l AS (SELECT id, max(updated_at) AS last FROM sessions GROUP BY 1), m AS (SELECT max(created_at) AS now FROM turns)
SELECT l.id FROM l, m WHERE l.last < m.now - INTERVAL 30 DAY AND l.id NOT IN (SELECT session_id FROM b)""")
def stale_unbundled(spark, d):
    """Sessions idle for 30 days, those without a title excluded as bundled."""
    s = table(spark, d, "sessions")
    bundled = s.filter("title is null or trim(title) = ''").select("id")
    now = table(spark, d, "turns").agg(F.max("created_at").alias("now"))
    last = s.groupBy("id").agg(F.max("updated_at").alias("last"))
    return last.crossJoin(F.broadcast(now)).filter(F.col("last") < F.col("now") - F.expr("INTERVAL 30 DAYS")).join(bundled, "id", "left_anti").select("id")  # one row of now


@query("""SELECT DISTINCT outcome_id, try_cast(nullif(regexp_extract(trim(as_of), '^(\\d{4}-\\d{2}-\\d{2})([T ].*)?$', 1), '') AS date) IS NULL AND as_of IS NOT NULL AND trim(as_of) <> '' AS malformed FROM outcomes""")
def as_of_check(spark, d):
    """Whether an as-of day is given but can't be read; the strict reader raises on such a one."""
    given = F.coalesce(F.trim("as_of") != "", F.lit(False))
    return table(spark, d, "outcomes").select("outcome_id", (given & iso_day(F.col("as_of")).isNull()).alias("malformed")).distinct()


#: What a passage says that speaks of a section.
SPOKEN = {"item_1c_cyber": "cyber", "item_7a_market_risk": r"currency|interest\s+rates?", "item_3_legal": r"patent|litigation|lawsuits?", "item_7_mda": r"costs?\b", "item_9a_controls": r"audit(?:ors?)?\b"}
_HEADS = ", ".join(f"('{s}', '{p}')" for s, p in SPOKEN.items())


@query(f"""WITH h(section_id, p) AS (VALUES {_HEADS}), k AS (SELECT DISTINCT ticker, fiscal_year FROM documents WHERE ticker IS NOT NULL AND fiscal_year IS NOT NULL), s AS (SELECT k.*, h.* FROM k CROSS JOIN h),
m AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.ticker = s.ticker AND d.fiscal_year = s.fiscal_year AND d.section_id = s.section_id))
SELECT m.ticker, m.fiscal_year, m.section_id, count(*) AS documents, min(d.doc_id) AS first_doc FROM m JOIN documents d ON d.ticker = m.ticker AND d.fiscal_year = m.fiscal_year AND regexp_matches(lower(d.text), m.p) GROUP BY 1, 2, 3""")
def absorb_evidence(spark, d):
    """Sections a filing lacks although another of its sections speaks of them."""
    docs = table(spark, d, "documents").filter("ticker is not null and fiscal_year is not null")
    return evaluate.absorbed(docs, ["ticker", "fiscal_year"], "section_id", "text", "doc_id", SPOKEN)
