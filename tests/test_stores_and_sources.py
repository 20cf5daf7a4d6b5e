"""Catalog, fact store, resolution, sources and limits on small fixtures."""

import random
import time

from pyspark.sql import functions as F

from ledgerline.operators import catalog
from ledgerline.operators import facts as store
from ledgerline.operators import resolve
from ledgerline.sources import files, inline
from ledgerline.streaming import limits
from tests.support import A, B, C, day, fact, facts, filing, filings, rows

HTML = b"""<html><head><meta charset="utf-8"></head><body><ix:header><ix:hidden><ix:nonNumeric name="dei:Name" contextRef="c1" id="h">Acme &amp; Co</ix:nonNumeric></ix:hidden><ix:resources>
<xbrli:context id="c1"><xbrli:entity><xbrli:identifier scheme="x">000123</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2020-01-01</xbrli:startDate><xbrli:endDate>2020-12-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="us-gaap:Axis">us-gaap:Member</xbrldi:explicitMember></xbrli:segment></xbrli:entity><xbrli:period><xbrli:instant>2020-12-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:unit id="u1"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id="u2"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit></ix:resources></ix:header>
<p>Sales <ix:nonFraction name="us-gaap:Revenues" contextRef="c1" unitRef="u1" scale="6" decimals="-6" format="ixt:num-dot-decimal" id="f1">39,000.5</ix:nonFraction>
<ix:nonFraction name="us-gaap:Loss" contextRef="c1" unitRef="u1" sign="-" scale="0">(12)</ix:nonFraction> <ix:nonFraction name="us-gaap:Eps" contextRef="c2" unitRef="u2">6.08</ix:nonFraction>
<ix:nonFraction name="us-gaap:Nil" contextRef="c1" unitRef="u9" xsi:nil="true"></ix:nonFraction><ix:nonNumeric name="dei:Text" contextRef="c1">Outer <ix:nonNumeric name="dei:Inner" contextRef="c1">inner</ix:nonNumeric></ix:nonNumeric></p></body></html>"""


def test_inline_documents(spark, tmp_path):
    (tmp_path / "a.htm").write_bytes(HTML)
    (tmp_path / "empty.htm").write_bytes(b"")
    scanned = inline.read(spark, str(tmp_path))
    got = {r.concept: r for r in inline.facts(scanned).collect()}
    assert float(got["us-gaap:Revenues"].value) == 39_000_500_000 and float(got["us-gaap:Loss"].value) == 12 and float(got["us-gaap:Eps"].value) == 6.08
    assert got["us-gaap:Eps"].unit == "USD/shares" and got["us-gaap:Eps"].period_type == "instant" and got["us-gaap:Eps"].dimensions[0].member == "us-gaap:Member"
    assert got["us-gaap:Nil"].value is None and got["us-gaap:Nil"].unit == "u9" and got["dei:Name"].value_text == "Acme & Co" and got["dei:Name"].hidden == "true"
    assert got["dei:Text"].value_text == "Outer inner" and got["dei:Inner"].value_text == "inner" and got["us-gaap:Revenues"].start_date == day("2020-01-01")
    assert {(r["format"], r["kind"]): r["n"] for r in inline.format_survey(scanned).collect()}["ixt:num-dot-decimal", "number"] == 1
    assert inline.decoded("é".encode("cp1252")) == "é" and inline.decoded(b'<meta charset="latin-1">\xe9').endswith("é")


def test_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1, "v": 1}\n\n// note\n{broken\n{"id": 1, "v": 2}\n{"id": 2, "v": 3}\n')
    assert rows(files.json_lines(spark, str(tmp_path / "x.jsonl"), "id int, v int", "id")) == [(1, 2), (2, 3)]
    doc = '{"facts": {"us-gaap": {"Assets": {"units": {"USD": [{"accn": "a", "end": "2020", "val": 5}, {"accn": "a", "end": "2020", "val": 6}, {"accn": null, "end": "2020", "val": 1}, {"accn": "b", "start": "2019", "end": "2020", "val": "7.5"}]}}}}}'
    got = rows(files.companyfacts(spark.createDataFrame([(doc,)], "c string"), "c"))
    assert [(r[0], r[1], r[2], float(r[5])) for r in got] == [("a", "us-gaap:Assets", "", 6.0), ("b", "us-gaap:Assets", "2019", 7.5)]
    sgml = "<SEC>\n<DOCUMENT>\n<TYPE>10-K\n<TEXT>one</TEXT>\n<DOCUMENT>\n<TYPE>EX-21\n<TEXT>no</TEXT>\n<DOCUMENT>\n<TYPE>EX-13.1\n<TEXT>two</TEXT>"
    assert spark.createDataFrame([(sgml,)], "s string").select(files.annual_parts(F.col("s"))).first()[0] == "one\n<!-- next document -->\ntwo"
    reg = files.companies(spark.createDataFrame([("aapl", "Apple Inc.", 320193), ("X", "Apple Hospitality REIT", 5)], "ticker string, title string, cik_str int"))
    assert rows(reg)[0] == ("AAPL", "Apple Inc.", "0000320193")
    assert rows(files.find_company(reg, spark.createDataFrame([("apple",), ("x",), ("zzz",)], "name string"))) == [("apple", "AAPL"), ("x", "X"), ("zzz", None)]
    out = str(tmp_path / "t")
    files.write_collections(spark.createDataFrame([("a", "1", "old"), ("a", "2", "stays"), ("b", "2", "kept")], "c string, id string, t string"), out, "id", "c")
    files.write_collections(spark.createDataFrame([("a", "1", "new"), ("a", "1", "newer"), ("a", "3", "added"), ("d", "1", "first")], "c string, id string, t string"), out, "id", "c", ["t"])
    assert rows(spark.read.parquet(out).select("c", "id", "t")) == [("a", "1", "newer"), ("a", "2", "stays"), ("a", "3", "added"), ("b", "2", "kept"), ("d", "1", "first")]
    have = spark.createDataFrame([("a", "1"), ("b", "1")], "c string, id string")
    assert rows(files.copy_collections(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "9"), ("c", "1")], "c string, id string"), have, "id", "c")) == [("a", "2"), ("c", "1")]


def test_catalog_pages_links_and_upserts(spark):
    pages = spark.createDataFrame([("T", 1, ["10-K", "8-K", "10-K/A"], [A, B, C], ["2020-01-01", "2020-01-01", ""], ["2020-02-01", "2020-02-01", "2020-03-01", "extra"])], "ticker string, cik int, form array<string>, accession array<string>, report array<string>, filed array<string>")
    assert [r.accession for r in catalog.submission_rows(pages).collect()] == [A]
    f = filings(spark, [filing(A), filing(B, "10-K/A", 2019, "2020-03-01"), filing(C, "10-K/A", 2021, "2021-03-01", end="2021-12-31")])
    assert rows(catalog.link_amendments(f)) == [(B, A), (C, None)]
    assert catalog.eligible(f, "2020-02-01").count() == 1 and catalog.eligible(f, " ").count() == 3
    s = spark.createDataFrame([("1", "x", "keep"), ("2", "y", None)], "k string, v string, own string")
    n = spark.createDataFrame([("1", None, "new"), ("2", "z", "new"), ("3", "w", "new")], "k string, v string, own string")
    assert rows(catalog.upsert(s, n, "k", ["own"])) == [("1", None, "keep"), ("2", "z", None), ("3", "w", "new")]
    x = spark.createDataFrame([("<InputFiles><File a='1'>a.htm</File><File>b.xsd</File><File>a.htm</File><File>C.HTML</File></InputFiles>",)], "x string")
    assert x.select(catalog.input_files(F.col("x"))).first()[0] == ["a.htm", "C.HTML"]
    y = spark.createDataFrame([("CONFORMED PERIOD OF REPORT: 20211231", None, A), (None, '{"reportDate": "2018-12-31"}', A), (None, None, A), (None, None, "x")], "h string, j string, a string")
    assert [r[0] for r in y.select(catalog.fiscal_year(F.col("h"), F.col("j"), F.col("a"))).collect()] == [2021, 2018, 2019, 2023]


def test_precision_preference_ignores_row_order(spark):
    r = random.Random(1)
    data = [fact(i, r.choice([1000, 1200, 1400, 9000]), r.choice(["-3", "0", "INF", None]), ctx=r.choice(["c1", "c2", None]), el=f"e{i}") for i in range(40)]
    want = rows(store.prefer_precise(facts(spark, data)).select("id"))
    for _ in range(2):
        r.shuffle(data)
        assert rows(store.prefer_precise(facts(spark, data)).select("id")) == want
    h = lambda d: rows(store.content_hash(facts(spark, d), ["concept", "value"]))
    assert h(data) == h(data[::-1]) and h(data) != h(data[1:])


def test_resolution_ladder(spark):
    f = filings(spark, [filing(A), filing(B, "10-K/A", 2019, "2020-06-01"), filing(C, label=2020, filed="2021-02-01", end="2020-12-31")])
    s = facts(spark, [fact(1, 5), fact(2, 6, acc=B), fact(3, 1, concept="Revenues", start="2019-01-01")[:10] + ("duration", day("2019-01-01"), day("2019-12-31"), "c", "d", "e"), fact(4, 2, concept="SalesRevenueNet")[:10] + ("duration", day("2019-01-01"), day("2019-12-31"), "c", "d", "e"), fact(5, 3, concept="ProfitLoss")[:10] + ("duration", day("2019-01-01"), day("2019-12-31"), "c", "d", "e")])
    ask = [("1", "t", "total_assets", 2019, None), ("2", "T", "total_assets", 2019, "2020-03-01"), ("3", "T", "total_assets", 2019, "2019-01-01"), ("4", "T", "total_assets", 2031, None), ("5", "T", "total_assets", 2001, None), ("6", "Z", "total_assets", 2019, None), ("7", "T", "no_such", 2019, None), ("8", "T", "revenue", 2019, None), ("9", "T", "net_income", 2019, None), ("91", "T", "capex", 2019, None), ("92", "T", "total_assets", 2020, None)]
    req = spark.createDataFrame([(i, t, m, "fiscal_label", y, None, d) for i, t, m, y, d in ask], "request_id string, ticker string, metric string, kind string, label int, period_end date, as_of string").withColumn("as_of", F.col("as_of").cast("date"))
    got = {r.request_id: (r.reason or float(r.value), r.rule, r.accession) for r in resolve.resolve(req, f, s, 2026).collect()}
    assert got["1"] == (6.0, "single_candidate", B) and got["2"] == (5.0, "single_candidate", A) and got["9"] == (3.0, "single_candidate_tier2", A)
    assert [got[k][0] for k in ("3", "4", "5", "6", "7", "8", "91", "92")] == ["period_not_filed_as_of", "future_period", "period_not_covered", "company_not_found", "metric_not_supported", "ambiguous_concept", "metric_not_found_in_filing", "period_not_covered"]
    late = req.filter("request_id = '1'").withColumn("kind", F.lit("latest"))
    assert resolve.resolve(late, f, s, 2026).first()["reason"] == "period_not_covered"  # the newest period has no facts


def test_overrides_amendments_and_validation(spark, monkeypatch):
    from ledgerline.operators import registry

    monkeypatch.setattr(registry, "OVERRIDES", [("total_assets", "T", None, 2018, "Old"), ("total_assets", "T", 2019, None, "Forced"), ("total_assets", "T", 2019, None, "Late")])
    f = filings(spark, [filing(A), filing(B, "10-K/A", 2019, "2020-06-01"), filing(C, ticker="U", label=2019), filing(C, ticker="U", label=2019)])
    s = facts(spark, [fact(1, 5), fact(2, 7000000, concept="Forced"), fact(3, 9, concept="Late"), fact(4, 1, acc=B), fact(5, 1234500, acc=C), fact(6, 1234500, acc=C)])
    s = s.withColumn("scale_raw", F.lit("3"))
    ask = spark.createDataFrame([("a", "T", 2019, "2020-03-01"), ("b", "T", 2019, "2020-07-01"), ("c", "U", 2019, None), ("d", None, 2019, None)], "request_id string, ticker string, label int, as_of string")
    req = ask.select("request_id", "ticker", F.lit("total_assets").alias("metric"), F.lit("fiscal_label").alias("kind"), "label", F.lit(None).cast("date").alias("period_end"), F.col("as_of").cast("date").alias("as_of"))
    got = resolve.resolve(req, f, s, 2026)
    seen = {r.request_id: r for r in got.collect()}
    assert (seen["a"].rule, seen["a"].value, seen["a"].amendment_accession) == ("override", 7000000, None)
    assert seen["b"].accession == A and seen["b"].amendment_accession == B  # the amendment lacks the prescribed concept
    assert seen["c"].rule == "single_candidate" and seen["d"].reason == "company_not_found"
    table = spark.createDataFrame([("T", 2019, "balance", " ".join(f"{i},000" for i in range(1, 30)) + " 7\u00a0000"), ("U", 2019, "balance", "1,234.5")], "ticker string, fiscal_label int, statement string, text string")
    assert {r.request_id: r.validation_status for r in resolve.validate(got, table).collect()} == {"a": "validated", "b": "validated", "c": "validated", "d": None}
    poor = table.withColumn("text", F.when(F.col("ticker") == "T", F.regexp_replace("text", "7,000", "")).otherwise("12"))
    assert {r.request_id: r.validation_status for r in resolve.validate(got, poor).collect()} == {"a": "conflict", "b": "conflict", "c": "unvalidated", "d": None}


def test_rate_limit_in_batch_and_as_a_stream(spark, tmp_path):
    r = random.Random(5)
    data = sorted((f"2026-01-01 00:{r.randrange(60):02d}:{r.randrange(60):02d}", r.randrange(3)) for _ in range(120))
    data = [(i, t, u) for i, (t, u) in enumerate(data)]
    ev = spark.createDataFrame(data, "event_id bigint, ts string, user_id bigint").withColumn("ts", F.col("ts").cast("timestamp"))
    want, logs = {}, {}
    for i, t, u in data:
        now = int(t[14:16]) * 60 + int(t[17:19])
        held = [x for x in logs.get(u, []) if now - x < 300]
        want[i] = len(held) < 3
        logs[u] = held + [now] if want[i] else held
    got = limits.rate_limit(ev, "user_id", "ts", "event_id", 300, 3).collect()
    assert {x.event_id: x.admitted for x in got} == want and all(x.retry_after >= 1 for x in got if not x.admitted)
    assert all(x.admitted for x in limits.rate_limit(ev, "user_id", "ts", "event_id", 300, 0).collect())
    assert limits.SlidingLog(60, 1, [0.0]).check(10) == (False, 51)
    src = str(tmp_path / "in")
    ev.coalesce(1).write.parquet(src)
    stream = limits.rate_limit_stream(spark.readStream.schema(ev.schema).parquet(src), "user_id", "ts", "event_id", 300, 3)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").start()
    for _ in range(120):  # idle state times out in batches without rows, so the stream is never "all processed"
        if len(spark.table("limited").take(len(want))) == len(want):
            break
        time.sleep(0.5)
    q.stop()
    assert {x.event_id: x.admitted for x in spark.table("limited").collect()} == want


def test_stream_indexer_resumes(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    schema = "id string, c string, t string"
    for k in range(2):
        spark.createDataFrame([("0", "a", "again"), (f"{k}", "a", "x"), (f"{k}", "a", "x"), (f"{k}", "b", "y")], schema).coalesce(1).write.mode("append").parquet(src)
        limits.index_stream(spark.readStream.schema(schema).parquet(src), out, cp, "id", "c").awaitTermination(120)
    assert rows(spark.read.parquet(out).select("c", "id")) == [("a", "0"), ("a", "1"), ("b", "0"), ("b", "1")]


def test_windows_and_limits(spark):
    ev = spark.createDataFrame([(1, "2026-01-01 00:00:00", 1.0), (1, "2026-01-01 00:10:00", 2.0), (1, "2026-01-01 02:00:00", 4.0)], "u int, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.n for r in limits.sessions(ev, "u", "ts", "30 minutes").orderBy("session_start").collect()] == [2, 1]
    assert rows(limits.tumbling(ev, "ts", "1 hour", ["u"], "v").select("n", "total")) == [(1, 4.0), (2, 3.0)]
    assert [r.used for r in limits.budget_use(ev, "u", "ts", "v", 600).orderBy("ts").collect()] == [1, 1, 1]
    a = spark.createDataFrame([("m", 5, None), ("n", 1, 1)], "k string, rpm int, tpm int")
    b = spark.createDataFrame([("m", 9, 7)], "k string, rpm int, tpm int")
    assert rows(limits.merged_limits(a, b, "k")) == [("m", 5, 7), ("n", 1, 1)]


def test_tables_become_grids(spark):
    from ledgerline.sources import tables

    html = "<table><tr><td colspan=2>Head</td><td>2020</td></tr><tr><td rowspan=2>Sales</td><td>$</td><td>391,035</td></tr><tr><td>x</td><td><table><tr><td>inner</td></tr></table>|</td></tr></table><table></table>"
    got = tables.grids(html)
    assert got[0] == [["Head", "Head", "2020"], ["Sales", "$", "391,035"], ["Sales", "x", "inner |"]] and got[1] == []
    assert not tables.is_data(got[0]) and tables.is_data([["a", "b"], ["x" * 61, ""]])
    assert tables.markdown(got[0]).split("\n")[1:3] == ["| --- | --- | --- |", "| Sales | $ | 391,035 |"] and "inner /" in tables.markdown(got[0])


def test_answers(spark):
    from ledgerline.operators import answering

    n = spark.createDataFrame([("a [7] b [3] c [7][12]",), ("none",), (None,)], "t string").coalesce(1)
    assert [r[0] for r in n.select(answering.renumber(F.col("t"))).collect()] == ["a [1] b [2] c [1][3]", "none", None]
    q = spark.createDataFrame([(1, "Compare Acme Rail's sales with The Acme Corp."), (2, "acme rail north"), (3, None), (4, "nothing")], "id int, q string")
    long = "one two three four five six seven eight nine"
    many = spark.createDataFrame([(1, f"What of {long} in 2020?")], "id int, q string")
    assert rows(answering.mentions(many, "id", "q", spark.createDataFrame([(long,), ("two three",)], "k string"), "k").select("key", "words")) == [(long, 9)]
    assert answering.mentions(many, "id", "q", many.select(F.col("q").alias("k")).limit(0), "k").count() == 0
    names = spark.createDataFrame([("acme",), ("acme rail",), ("rail north",), ("",), (None,)], "k string")
    assert {tuple(r) for r in answering.mentions(q, "id", "q", names, "k").select("id", "key").collect()} == {(1, "acme"), (1, "acme rail"), (2, "acme rail"), (2, "rail north")}
    k = spark.createDataFrame([("The Acme Holdings, Inc.",), ("Zen's Co.",)], "n string").coalesce(1)
    assert [r[0] for r in k.select(answering.phrase_key(F.col("n"))).collect()] == ["acme", "zen"]
