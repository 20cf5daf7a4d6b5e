"""Search queries over documents, embeddings and held-out questions, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval
from ..runtime import broadcast_if_small, cut, table
from .question_queries import compressed_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_DENSE = """q AS (SELECT vec_id AS query_id, embedding::double[] AS v, label AS ql FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.query_id, q.ql, e.vec_id, e.label, round(list_cosine_similarity(q.v, e.embedding::double[]), 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.query_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5)"""


def _dense(spark, d):
    e = table(spark, d, "embeddings")
    return retrieval.dense_topk(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)


@query(f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM t")
def dense_topk(spark, d):
    return _dense(spark, d).withColumnRenamed("ident", "vec_id")


@query(f"""WITH {_DENSE}, h AS (SELECT query_id, min(rank) FILTER (WHERE label = ql) AS first FROM t GROUP BY 1)
SELECT count(*) AS queries, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM h""")
def hit_at_k_mrr(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    hits = _dense(spark, d).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").join(labels.select(F.col("vec_id").alias("ident"), "label"), "ident")
    first = hits.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))).alias("first"))
    return first.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


_W = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_BM25 = f"""a AS (SELECT DISTINCT item_id AS query_id, unnest({_W.format('question')}) AS term FROM gold_items WHERE question IS NOT NULL),
w AS (SELECT doc_id, {_W.format('text')} AS w FROM documents WHERE text IS NOT NULL),
z AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
p AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM p WHERE term IN (SELECT term FROM a) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT a.query_id, tf.doc_id, round(sum(ln(1 + (z.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (1 - 0.75 + 0.75 * tf.len / z.mean))), 6) AS score, count(*) AS matched
  FROM a JOIN tf USING (term) JOIN df USING (term), z GROUP BY 1, 2),
sparse AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 40),
coord AS (SELECT query_id, doc_id, matched, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, doc_id) AS rank FROM bm QUALIFY rank <= 40)"""


def _questions(spark, d):
    return table(spark, d, "gold_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def _bm25(spark, d):
    return retrieval.bm25(_questions(spark, d), table(spark, d, "documents").select("doc_id", "text"), retrieval.CANDIDATES)


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM sparse WHERE rank <= 10")
def bm25_topk(spark, d):
    return retrieval.top(_bm25(spark, d), ["query_id"], [F.desc("score"), F.col("doc_id")], 10).select("query_id", "doc_id", "score", "rank")


def _fused(spark, d):
    b = _bm25(spark, d)
    sparse = retrieval.top(b, ["query_id"], [F.desc("score"), F.col("doc_id")], retrieval.CANDIDATES)
    coord = retrieval.top(b, ["query_id"], [F.desc("matched"), F.col("doc_id")], retrieval.CANDIDATES)
    return retrieval.fuse([sparse, coord])


_RRF = f"{_BM25}, rrf AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM sparse UNION ALL SELECT query_id, doc_id, rank FROM coord) GROUP BY 1, 2)"


@query(f"WITH {_RRF} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rrf QUALIFY rank <= 40")
def rrf_hybrid(spark, d):
    return retrieval.top(_fused(spark, d), ["query_id"], [F.desc("score"), F.col("doc_id")], retrieval.CANDIDATES)


@query(f"""WITH {_RRF}, c AS (SELECT query_id, doc_id, score, 1 AS pass_no FROM sparse UNION ALL SELECT query_id, doc_id, matched::double AS score, 2 FROM coord)
SELECT query_id, doc_id, score, pass_no FROM c QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, pass_no) = 1""")
def candidate_union(spark, d):
    b = _bm25(spark, d)
    sparse = retrieval.top(b, ["query_id"], [F.desc("score"), F.col("doc_id")], retrieval.CANDIDATES).select("query_id", "doc_id", "score", F.lit(1).alias("pass_no"))
    coord = retrieval.top(b, ["query_id"], [F.desc("matched"), F.col("doc_id")], retrieval.CANDIDATES).select("query_id", "doc_id", F.col("matched").cast("double").alias("score"), F.lit(2).alias("pass_no"))
    return retrieval.best_of(sparse.unionByName(coord))


_DIV = f"""{_RRF}, g AS (SELECT rrf.*, d.ticker, d.fiscal_year, d.section_id FROM rrf JOIN documents d USING (doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id, ticker, fiscal_year, section_id ORDER BY score DESC, doc_id) AS in_group FROM g QUALIFY in_group <= 2),
dv AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM i QUALIFY rank <= 3)"""


@query(f"WITH {_DIV} SELECT * FROM dv")
def diversity_quota(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "ticker", "fiscal_year", "section_id")
    return retrieval.diversify(_fused(spark, d).join(docs, "doc_id"), ["ticker", "fiscal_year", "section_id"]).select("query_id", "doc_id", "score", "rank")


_HASHED = f"""tk AS (SELECT 'q' AS side, item_id AS id, unnest({_W.format('question')}) AS term FROM gold_items WHERE question IS NOT NULL UNION ALL SELECT 'd', doc_id, unnest({_W.format('text')}) FROM documents WHERE text IS NOT NULL),
tc AS (SELECT side, id, term, sqrt(count(*)) AS x FROM tk GROUP BY 1, 2, 3), bk AS (SELECT side, id, ('0x' || substr(md5(term), 1, 6))::int % 256 AS b, sum(x) AS x FROM tc GROUP BY 1, 2, 3), nb AS (SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY side, id)) AS u FROM bk),
dense AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.u * d.u), 6) AS score FROM nb q JOIN nb d ON q.side = 'q' AND d.side = 'd' AND q.b = d.b GROUP BY 1, 2),
dk AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense QUALIFY rank <= 40)"""
_HYBRID = f"{_BM25}, {_HASHED}, hy AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM sparse UNION ALL SELECT query_id, doc_id, rank FROM dk) GROUP BY 1, 2), hk AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hy QUALIFY rank <= 40)"


def _dense_texts(spark, d):
    """Questions' nearest documents by hashed vectors."""
    docs = retrieval.hashed_vectors(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "id")
    # questions and documents are numbered apart, so a question's id is moved out of the way of a document's
    asked = retrieval.hashed_vectors(_questions(spark, d), "query_id", "text").select((-F.col("query_id") - 1).alias("id"), "embedding")
    found = retrieval.dense_topk(asked, docs, "id", "embedding", retrieval.CANDIDATES)
    return found.select((-F.col("query_id") - 1).alias("query_id"), F.col("ident").alias("doc_id"), "score", "rank")


@query(f"WITH {_HASHED} SELECT * FROM dk")
def hashed_topk(spark, d):
    """Documents nearest to each question by model-free vectors."""
    return _dense_texts(spark, d)


def _sparse(spark, d):
    return retrieval.top(_bm25(spark, d), ["query_id"], [F.desc("score"), F.col("doc_id")], retrieval.CANDIDATES)


def _hybrid(spark, d):
    return retrieval.top(retrieval.fuse([_sparse(spark, d), _dense_texts(spark, d)]), ["query_id"], [F.desc("score"), F.col("doc_id")], retrieval.CANDIDATES)


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, score, rank FROM hk")
def dense_sparse_hybrid(spark, d):
    """Dense and sparse lists of each question fused by rank."""
    return _hybrid(spark, d)


_PASSES = f"""{_HYBRID}, tb AS (SELECT hy.query_id, hy.doc_id, hy.score, row_number() OVER (PARTITION BY hy.query_id ORDER BY hy.score DESC, hy.doc_id) AS rank FROM hy JOIN documents d USING (doc_id) WHERE contains(d.text, '|') QUALIFY rank <= 10),
key1 AS (SELECT hk.query_id, d.ticker, d.fiscal_year FROM hk JOIN documents d USING (doc_id) WHERE hk.rank = 1 AND d.ticker IS NOT NULL AND d.fiscal_year IS NOT NULL),
sc AS (SELECT ticker, fiscal_year, section_id, doc_id, row_number() OVER (PARTITION BY ticker, fiscal_year, section_id ORDER BY doc_id) AS r FROM documents WHERE section_id IN ('item_8_financials', 'item_1a_risk_factors', 'notes') QUALIFY r <= 5),
ps AS (SELECT query_id, doc_id, score, 1 AS pass_no FROM hk WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, score, 2 FROM tb UNION ALL SELECT k.query_id, sc.doc_id, 0.4, CASE section_id WHEN 'item_8_financials' THEN 3 WHEN 'item_1a_risk_factors' THEN 4 ELSE 5 END FROM key1 k JOIN sc ON sc.ticker = k.ticker AND sc.fiscal_year = k.fiscal_year),
un AS (SELECT query_id, doc_id, score, pass_no FROM ps QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, pass_no) = 1),
cp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM un QUALIFY rank <= 40)"""


def _passes(spark, d):
    """Candidates of five passes: the fused list, its tables, and three sections of the best hit's filing; best score of each, capped."""
    docs = table(spark, d, "documents").select("doc_id", "ticker", "fiscal_year", "section_id", F.contains("text", F.lit("|")).alias("tabular"))
    fused = cut(retrieval.fuse([_sparse(spark, d), _dense_texts(spark, d)]))
    order = [F.desc("score"), F.col("doc_id")]
    main = retrieval.top(fused, ["query_id"], order, 10)
    tables = retrieval.top(fused.join(docs.filter("tabular").select("doc_id"), "doc_id", "left_semi"), ["query_id"], order, 10)
    key = main.filter("rank = 1").join(docs, "doc_id").select("query_id", "ticker", "fiscal_year").filter("ticker is not null and fiscal_year is not null")
    out = main.select("query_id", "doc_id", "score", F.lit(1).alias("pass_no")).unionByName(tables.select("query_id", "doc_id", "score", F.lit(2).alias("pass_no")))
    for n, section in enumerate(("item_8_financials", "item_1a_risk_factors", "notes"), 3):
        out = out.unionByName(retrieval.scroll(docs, key, section, ["ticker", "fiscal_year"], 5).withColumn("pass_no", F.lit(n)))
    return retrieval.top(retrieval.best_of(out), ["query_id"], order, retrieval.CANDIDATES)


@query(f"WITH {_PASSES} SELECT query_id, doc_id, score::double AS score, pass_no, rank FROM cp")
def candidate_passes(spark, d):
    return _passes(spark, d)


@query()
def reranked(spark, d):
    """Candidates of the five passes in the order of the lexical stand-in, with the boost of risk factors; the best three of different sections."""
    return _reranked(spark, d, True)


def _reranked(spark, d, focus: bool):
    docs = table(spark, d, "documents").select("doc_id", "text", "ticker", "fiscal_year", "section_id")
    cand = cut(_passes(spark, d).select("query_id", "doc_id"))
    met = cand.join(docs, "doc_id").join(_questions(spark, d).withColumnRenamed("text", "question"), "query_id")
    score = retrieval.rerank_score(F.col("question"), F.col("text"))
    if focus:
        score = score + retrieval.focus_boost("risk_factors", F.col("text"), F.col("section_id"), F.col("section_id"))
    scored = met.select("query_id", "doc_id", "ticker", "fiscal_year", "section_id", F.round(score, 6).alias("score"))
    return retrieval.diversify(scored, ["ticker", "fiscal_year", "section_id"]).select("query_id", "doc_id", "section_id", "score", "rank")


def _pairs_sql(w: str) -> str:
    return f"CASE WHEN len({w}) > 1 THEN list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1])) ELSE []::varchar[] END"


@query(f"""WITH {_HYBRID}, rt AS (SELECT hk.query_id, hk.doc_id, {_W.format("coalesce(g.question, '')")} AS q, {_W.format(compressed_sql("coalesce(d.text, '')"))} AS d FROM hk JOIN documents d USING (doc_id) JOIN gold_items g ON g.item_id = hk.query_id WHERE hk.rank <= 10),
rp AS (SELECT *, {_pairs_sql('q')} AS qp, {_pairs_sql('d')} AS dp FROM rt)
SELECT query_id, doc_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(list_distinct(q), list_distinct(d)))::double / len(list_distinct(q)) END + 0.5 * CASE WHEN len(qp) = 0 THEN 0 ELSE len(list_intersect(qp, dp))::double / len(qp) END, 6) AS score FROM rp""")
def rerank_scores(spark, d):
    """The stand-in's score of every question with the ten best documents of the fused list."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    met = cut(_hybrid(spark, d).filter("rank <= 10").select("query_id", "doc_id")).join(docs, "doc_id").join(_questions(spark, d).withColumnRenamed("text", "question"), "query_id")
    return met.select("query_id", "doc_id", retrieval.rerank_score(F.col("question"), F.col("text")).alias("score"))


@query(f"""WITH {_DIV}, {_HASHED}, hy AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT query_id, doc_id, rank FROM sparse UNION ALL SELECT query_id, doc_id, rank FROM dk) GROUP BY 1, 2), hk AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hy QUALIFY rank <= 5),
al AS (SELECT 'bm25' AS arm, query_id, doc_id, rank FROM sparse WHERE rank <= 5 UNION ALL SELECT 'coordination', query_id, doc_id, rank FROM coord WHERE rank <= 5 UNION ALL SELECT 'dense', query_id, doc_id, rank FROM dk WHERE rank <= 5 UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM hk UNION ALL SELECT 'hybrid_diverse', query_id, doc_id, rank FROM dv),
ft AS (SELECT arm, query_id, count(*) AS n, min(rank) FILTER (WHERE d.section_id IN ('notes', 'item_8_financials')) AS first FROM al JOIN documents d USING (doc_id) GROUP BY 1, 2)
SELECT arm, sum(n)::bigint AS results, count(*) AS queries, round(avg(CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END), 9) AS hit_rate, round(avg(coalesce(1.0 / first, 0)), 9) AS mrr FROM ft GROUP BY 1""")
def ablation_arms(spark, d):
    """Five arms that SQL can express, each with its hit rate and mean reciprocal rank of the financial sections among five results."""
    return _arms(spark, d, {"bm25": _sparse(spark, d), "coordination": retrieval.top(_bm25(spark, d), ["query_id"], [F.desc("matched"), F.col("doc_id")], 5), "dense": _dense_texts(spark, d), "hybrid": _hybrid(spark, d), "hybrid_diverse": diversity_quota(spark, d)})


def _arms(spark, d, lists):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.col("section_id").isin("notes", "item_8_financials"), F.lit(False)).alias("right"))
    out = None
    for name, hits in lists.items():
        part = hits.filter("rank <= 5").select(F.lit(name).alias("arm"), "query_id", "doc_id", "rank")
        out = part if out is None else out.unionByName(part)
    first = out.join(docs, "doc_id").groupBy("arm", "query_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("right"), F.col("rank"))).alias("first"))
    return first.groupBy("arm").agg(F.sum("n").alias("results"), F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0)), 9).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 9).alias("mrr"))


@query()
def ablation_reranked(spark, d):
    """The arms behind a reranker: fused, with the stand-in, with the boost on top."""
    return _arms(spark, d, {"hybrid": _hybrid(spark, d), "rerank": _reranked(spark, d, False), "rerank_focus": _reranked(spark, d, True)})


def _boost_sql() -> str:
    r = lambda f: f"coalesce(regexp_matches(text, '{retrieval.row_pattern(f)}'), false)"
    has = lambda *xs: "(" + " OR ".join(f"coalesce(contains(lower(text), '{x}'), false)" for x in xs) + ")"
    sec = "lower(coalesce(section_id, ''))"
    stated = f"contains({sec}, 'consolidated statements')"
    sheet = f"(contains({sec}, 'balance sheet') OR contains({sec}, 'financial condition'))"
    income = lambda f, *names: f"CASE WHEN {stated} AND {r(f)} THEN 10.0 WHEN {stated} THEN 6.0 WHEN {r(f)} THEN 2.0 WHEN {has(*names)} THEN 0.5 ELSE 0.0 END"
    cases = {
        "revenue": f"CASE WHEN {r('revenue')} OR {has('total net sales', 'total revenue', 'total net revenues')} THEN 8.0 WHEN {has('net sales', 'revenue')} THEN 2.0 ELSE 0.0 END",
        "rd_expense": f"CASE WHEN {r('rd_expense')} THEN 10.0 WHEN {has('research and development')} THEN 2.0 ELSE 0.0 END",
        "net_income": income("net_income", "net income"), "operating_income": income("operating_income", "operating income", "income from operations"),
        "balance_sheet": f"CASE WHEN {sheet} AND {r('balance_sheet')} THEN 10.0 WHEN {sheet} THEN 6.0 WHEN {r('balance_sheet')} OR {has('cash and cash equivalents')} THEN 2.0 ELSE 0.0 END",
        "segment_info": f"CASE WHEN {has('segment')} THEN CASE WHEN contains({sec}, 'notes') THEN 8.0 ELSE 4.0 END ELSE 0.0 END",
        **{f: f"CASE WHEN section_id = '{s}' THEN 8.0 ELSE 0.0 END" for f, s in retrieval.SECTION_OF.items()},
    }
    return "SELECT doc_id, " + ", ".join(f"({c})::double AS {f}" for f, c in cases.items()) + " FROM documents"


@query(_boost_sql())
def focus_boost(spark, d):
    """What every focus adds to every document."""
    t, s = F.col("text"), F.col("section_id")
    return table(spark, d, "documents").select("doc_id", *[retrieval.focus_boost(f, t, s, s).alias(f) for f in (*retrieval.ROW_LABELS, "segment_info", *retrieval.SECTION_OF)])


@query(f"""WITH {_DIV}, sec AS (SELECT ticker, fiscal_year, section_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM documents WHERE ticker IS NOT NULL AND fiscal_year IS NOT NULL AND section_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT dv.query_id, dv.doc_id, CASE WHEN regexp_matches(sec.t, '\\S') THEN sec.t ELSE d.text END AS parent_text FROM dv JOIN documents d USING (doc_id) LEFT JOIN sec ON sec.ticker = d.ticker AND sec.fiscal_year = d.fiscal_year AND sec.section_id = d.section_id""")
def parent_lookup(spark, d):
    """Hits with the whole text of their section, their own where the section is missing or blank."""
    docs = table(spark, d, "documents").select("doc_id", "ticker", "fiscal_year", "section_id", "text")
    keys = ["ticker", "fiscal_year", "section_id"]
    hits = cut(diversity_quota(spark, d).select("query_id", "doc_id"))
    n = hits.count()
    own = cut(docs.join(broadcast_if_small(hits, n, 32), "doc_id"))
    return retrieval.with_parent(own, retrieval.section_texts(docs, own, keys, n), keys).select("query_id", "doc_id", "parent_text")
