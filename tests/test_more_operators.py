"""Answers, retrieval, failover and source formats on small fixtures."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import runtime
from ledgerline.functions import phrases, questions
from ledgerline.operators import answers, evaluate, retrieval, upkeep
from ledgerline.sources import files
from ledgerline.streaming import limits
from tests.support import day, rows

FIGURES = "ticker string, metric string, fiscal_label int, end_date date, value decimal(38,10), unit string, accession string, filing_date date, form_type string, restated boolean, amendment_accession string"


def figure(y, v, ticker="T", metric="revenue", restated=False, amendment=None, unit="USD", end=None):
    return (ticker, metric, y, day(end or f"{y}-12-31"), Decimal(v), unit, "a", day("2020-02-01"), "10-K/A", restated, amendment)


def test_answer_texts(spark):
    df = spark.createDataFrame([figure(2019, 391035000000), figure(2020, 5, restated=True), figure(2021, -1500000, amendment="b"), figure(2022, "6.08", metric="eps_diluted", unit="USD/shares")], FIGURES)
    cols = {c: F.col(c) for c in answers.FIGURE}
    got = {r.fiscal_label: r.t for r in df.select("fiscal_label", answers.numeric_text(cols, F.lit("2024-01-01")).alias("t")).collect()}
    assert got[2019] == "T's total net revenue for fiscal 2019 (year ended 2019-12-31) was $391.04 billion ($391,035,000,000). [1] Only filings public on or before 2024-01-01 were used."
    assert "This figure is restated: it comes from 10-K/A a, filed 2020-02-01, which superseded the original filing for fiscal 2020." in got[2020]
    assert "An amendment to the fiscal 2021 filing exists (b) but does not restate this figure." in got[2021] and "-$1.50 million (-$1,500,000)" in got[2021]
    assert "$6.08 per share" in got[2022] and "diluted earnings per share" in got[2022]
    trend = answers.trend_text(df.filter("metric = 'revenue'"), ["ticker"], F.lit(None).cast("string")).first().text
    assert trend.startswith("T's total net revenue, fiscal 2019 to 2021:\n- fiscal 2019 (ended 2019-12-31): $391.04 billion") and trend.endswith("Over that span it fell $391.04 billion ($391,036,500,000).")
    pair = spark.createDataFrame([figure(2020, 100, "A"), figure(2020, 150, "B", end="2020-09-30")], FIGURES)
    text = answers.compare_text(pair, ["metric"], F.lit("")).first().text
    assert text == "Total net revenue, as each company reports it:\n- A: $100.00 for fiscal 2020 (year ended 2020-12-31) [1]\n- B: $150.00 for fiscal 2020 (year ended 2020-09-30) [2]\n\nB reported $50.00 more than A, 50.00% higher. Note the fiscal years end on different dates, so the periods are not identical."
    assert answers.compare_text(pair.withColumn("unit", F.col("ticker")), ["metric"], F.lit("")).first().text.endswith("[2]")


def test_calculation_labels(spark):
    df = spark.createDataFrame([figure(2020, 5), figure(2019, 4), figure(2020, 2, metric="total_assets")], FIGURES)
    a, b, c = ({k: F.lit(getattr(r, k)) for k in ("metric", "fiscal_label")} for r in df.collect())
    get = lambda op, x, y: spark.range(1).select(answers.calculation_label(F.lit(op), x, y)).first()[0]
    assert get("growth_pct", a, b) == "total net revenue growth, fiscal 2019 to 2020" and get("ratio", a, c) == "ratio of total net revenue to total assets for fiscal 2020"
    assert get("difference", a, c) == "total net revenue less total assets, fiscal 2020" and get("sum", a, b) == "sum for fiscal 2019 to 2020"


def test_windows_marks_and_cells(spark):
    parent = "head " * 50 + "the passage that was found by the search and is long enough to be a probe of its own" + " tail" * 50
    df = spark.createDataFrame([(parent, "the passage that was found by the search and is long enough to be a probe of its own"), (parent, "the passage that was found by the search and is long enough but it ends in another way altogether, sadly"), (parent, "nowhere"), ("short", "x"), (parent, "")], "p string, c string").coalesce(1)
    got = [r[0] for r in df.select(answers.window_around(F.col("p"), F.col("c"), 120)).collect()]
    assert "the passage that was found" in got[0] and got[0].startswith(" […] ") and "the passage that was found" in got[1] and got[2] == parent[:120] + " […] " and got[3] == "short"
    m = spark.createDataFrame([("a 1.5 < 11.5 & 1.50, 1.5.", "1.5"), (None, "1"), ("x", None)], "t string, n string").coalesce(1)
    assert [r[0] for r in m.select(answers.highlighted(F.col("t"), F.col("n"))).collect()] == ["a <mark>1.5</mark> &lt; 11.5 &amp; 1.50, <mark>1.5</mark>.", "", "x"]
    cells = [("$ (1,234.50)", "-1234.5"), ("—5%", "-5"), ("0.00", "0"), ("Total", None), ("", None), (None, None), ("2024", "2024"), ("1 234", "1234")]
    c = spark.createDataFrame([(x,) for x, _ in cells], "c string").coalesce(1)
    assert [r[0] for r in c.select(answers.canonical_numeral(F.col("c"))).collect()] == [x for _, x in cells]
    s = spark.createDataFrame([("Yes [1] 【2】",), ("It isn’t stated in 2020.",), ("I don't know, maybe 1,234",), ("[9]",), (None,)], "t string").coalesce(1)
    assert [(r[0].style, r[0].invented, r[0].refused, r[0].compliant) for r in s.select(answers.reply_style(F.col("t"), 3)).collect()] == [("mixed", [], False, False), ("none", [], True, True), ("none", [], True, False), ("ascii", [9], False, False), ("none", [], False, False)]


@pytest.mark.parametrize("limit", [48 << 20, -1])
def test_bm25_in_tasks_equals_the_joins(spark, monkeypatch, limit):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(r.choice(vocab) for _ in range(r.randrange(40))) if i % 9 else r.choice([None, ""])) for i in range(120)], "doc_id bigint, text string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(r.choice([*vocab, "unknown"]) for _ in range(6))) for q in range(7)] + [(9, None), (10, "?")], "query_id bigint, text string")
    monkeypatch.setattr(runtime, "BROADCAST_LIMIT_BYTES", limit)
    every = retrieval.bm25_all(asked, docs)
    for by in ("score", "matched"):
        order = [F.desc(by), F.col("doc_id")]
        want = rows(retrieval.top(every, ["query_id"], order, 5).select("query_id", "doc_id", F.round("score", 5), "matched", "rank"))
        assert rows(retrieval.top(retrieval.bm25(asked, docs, 5), ["query_id"], order, 5).select("query_id", "doc_id", F.round("score", 5), "matched", "rank")) == want and want
    assert retrieval.bm25(asked.limit(0), docs, 5).count() == 0 and retrieval.bm25(asked, docs.limit(0), 5).count() == 0


@pytest.mark.parametrize("block", [4096, 3])
def test_dense_search_in_blocks_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK", block)
    monkeypatch.setattr(retrieval, "PART", 20)
    r = np.random.default_rng(1)
    v = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(50)] + [(50, None), (51, [1.0]), (52, [0.0] * 4)]
    df = spark.createDataFrame(v, "i bigint, v array<float>").repartition(4)
    got = rows(retrieval.dense_topk(df.filter("i % 5 = 0"), df, "i", "v", 3).select("query_id", "ident", "rank"))
    want = []
    for q, x in v:
        if q % 5 or x is None or len(x) != 4 or not any(x):
            continue
        s = [(-round(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)), 6), i) for i, y in v if i != q and y is not None and len(y) == 4 and any(y)]
        want += [(q, i, k + 1) for k, (_, i) in enumerate(sorted(s)[:3])]
    assert got == sorted(want, key=repr)
    assert retrieval.dense_topk(df.limit(0), df, "i", "v", 3).count() == 0


def test_hashed_vectors_and_reranking(spark):
    d = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, None)], "id bigint, t string")
    got = {r.id: r.embedding for r in retrieval.hashed_vectors(d, "id", "t", 16).collect()}
    assert set(got) == {1, 2} and abs(sum(x * x for x in got[1]) - 1) < 1e-9 and not any(got[2])
    q = spark.createDataFrame([("net revenue rose", "Net revenue rose"), ("net revenue rose", "rose, revenue; net"), ("net revenue rose", None), (None, "x"), ("one", "one")], "q string, t string").coalesce(1)
    assert [r[0] for r in q.select(retrieval.rerank_score(F.col("q"), F.col("t"))).collect()] == [1.5, 1.0, 0.0, 0.0, 1.0]


def test_failover_asks_in_order(spark):
    calls = [("a", 1, "m", 1, "rate_limited"), ("a", 1, "m", 2, "ok"), ("a", 2, "n", 1, "ok"), ("b", 1, "m", 1, "empty"), ("b", 1, "m", 2, "ok"), ("b", 2, "n", 1, "ok"), ("c", 1, "m", 1, "timeout"), ("c", 1, "m", 2, "timeout"), ("c", 1, "m", 3, "timeout"), ("c", 1, "m", 4, "ok"), ("d", 1, "m", 1, "refused"), ("d", 2, "n", 1, "empty")]
    df = spark.createDataFrame(calls, "r string, position int, candidate string, attempt int, outcome string")
    assert rows(limits.failover(df, "r")) == [("a", "m", 2, "ok"), ("b", "n", 2, "ok"), ("c", "m", 3, "timeout"), ("d", "n", 2, "empty")]
    c = spark.createDataFrame([("x", 2, ["json"]), ("y", 1, ["json", "long"]), ("z", 1, None)], "name string, rank int, caps array<string>")
    assert rows(limits.order_for_role(c, ["json"]).select("name", "position")) == [("x", 2), ("y", 1)] and limits.order_for_role(c, []).count() == 3


def test_writes_in_phases_and_cached_documents(spark, tmp_path):
    chunks = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, first boolean")
    limits.write_in_phases(chunks, "first", str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1,), (2,), (3,)]
    (tmp_path / "c").mkdir()
    for name, text in (("a.json", '{"x": 1}'), ("b.json", ""), ("c.json", "Your request originates from an undeclared automated tool"), ("d.json", "{broken")):
        (tmp_path / "c" / name).write_text(text)
    assert rows(files.cached_documents(spark, str(tmp_path / "c"))) == [("a.json", '{"x": 1}')]
    upkeep.write_report(chunks, str(tmp_path / "r"), "json")
    assert spark.read.json(str(tmp_path / "r")).count() == 3


def test_phrases_and_routes(spark):
    assert phrases.any_of("worr//y/ies, threat/s of|to x", "z+") == r"(?i)\b(?:(?:worry|worries)|(?:threat|threats)\s+(?:of|to)\s+x)\b|z+"
    cases = [("Should I buy Acme?", "abstain", "out_of_scope"), ("Revenue in Q3 2020?", "abstain", "unsupported_period_type"), ("What was revenue in 2020?", "facts", None), ("How much was deferred revenue in 2020?", "abstain", "metric_not_supported"), ("Which risks does it name?", "text", None), ("hello", "clarify", None), ("What is the ratio of revenue in 2020?", "abstain", "metric_not_supported"), ("What is the ratio of total liabilities to equity in 2020?", "facts", None), (None, "clarify", None)]
    df = spark.createDataFrame([(q,) for q, _, _ in cases], "q string").coalesce(1).withColumn("p", questions.period(F.col("q"), 2026))
    got = [(r[0].path, r[0].reason) for r in df.select(questions.route(F.col("q"), F.lit(1), F.col("p"))).collect()]
    assert got == [(p, r) for _, p, r in cases]
    m = spark.createDataFrame([("deferred revenue and net income",), (None,)], "q string").coalesce(1)
    assert [(r[0].named, r[0].killed) for r in m.select(questions.metric_mentions(F.col("q"))).collect()] == [(["net_income"], ["revenue"]), ([], [])]
    j = spark.createDataFrame([('{"query_type": "trend", "tickers": ["t"], "years": [2020], "metric": "revenue"}',), ('{"query_type": "poem"}',), ('{"query_type": "trend", "years": [1800]}',), ("no json",), (None,)], "t string").coalesce(1)
    assert [r[0] is not None for r in j.select(questions.route_from_json(F.col("t"))).collect()] == [True, False, False, False, False]


def test_fingerprints_and_percentiles(spark):
    a = spark.createDataFrame([("x", str(i)) for i in range(300)] + [("y", None)], "g string, v string")
    h = lambda df: rows(upkeep.fingerprint(df, ["g"], F.coalesce("v", F.lit(""))))
    assert h(a) == h(a.repartition(5)) and h(a) != h(a.filter("v <> '7' or v is null")) and {r[0]: r[1] for r in h(a)} == {"x": 300, "y": 1}
    p = spark.createDataFrame([("g", v) for v in (1, 2, 2, 9, None)], "g string, v int")
    assert rows(evaluate.floor_rank(p, ["g"], "v", 0.95, "p")) == [("g", 9)] and rows(evaluate.floor_rank(p, ["g"], "v", 0.5, "p")) == [("g", 2)]
