"""Scoring on golden answers."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import scoring, upkeep
from tests.support import rows

CASES = [
    ("It was $39.0 billion.", "39000966000", {}, "correct"), ("net revenue of 391,035 million", "391035000000", {}, "correct"), ("It was $391.0 million.", "391035000000", {}, "scale_error"), ("It was 1", "100000000000", {}, "wrong_value"), ("It was -5 million", "5000000", {}, "sign_error"), ("(5,000)", "-5000", {}, "correct"),
    ("It was 0.3151", "31.51", {"percent": True}, "unit_error"), ("It was 31.51", "31.51", {"percent": True}, "correct"), ("It was 0.3151", "31.51", {}, "scale_error"), ("It was 31.6%", "31.51", {"abs": "0.1"}, "correct"), ("It was 102", "100", {"rel": 0.03}, "correct"), ("It was 104", "100", {"rel": 0.03}, "wrong_value"),
    ("It was 250 million", "900000000", {"other": [("period", "250000000")]}, "wrong_period"), ("It was 250 million", "900000000", {"other": [("entity", "250000000"), ("period", "250000000")]}, "wrong_entity"), ("none", "9", {}, "missing_number"), (None, "9", {}, "missing_number"), ("[1] on 2024-11-01", "9", {}, "missing_number"), ("It was 0", "9", {}, "wrong_value"), ("7 then 9", "9", {}, "correct"), ("It was 7", None, {}, "wrong_value"),
]


@pytest.mark.parametrize(("text", "expected", "how", "verdict"), CASES)
def test_figures_of_a_text(spark, text, expected, how, verdict):
    df = spark.createDataFrame([(text, None if expected is None else Decimal(expected), how.get("other"))], "t string, e decimal(38,10), o array<struct<kind:string,value:string>>").coalesce(1)
    got = scoring.match_value(F.col("t"), F.col("e"), F.lit(how["rel"]) if "rel" in how else None, F.lit(how["abs"]).cast("decimal(38,10)") if "abs" in how else None, F.lit(True) if how.get("percent") else None, F.col("o") if "other" in how else None)
    assert df.select(got).first()[0] == verdict


def cite(index=1, kind="fact", metric="revenue", value="5", section=""):
    return (index, kind, metric, value, "0000000001-20-000001", "2020-02-01", section)


def answers(spark, data):
    return spark.createDataFrame(data, f"id int, status string, answer string, citations {scoring.CITATION}").coalesce(1)


def test_numeric_and_computed_answers(spark):
    df = answers(spark, [(1, "answered", "It was 5", [cite()]), (2, "answered", "It was 5", [cite(metric="assets", value="9")]), (3, "answered", "It was 5", [cite(value="9")]), (4, "answered_text", "It was 5", None), (5, "abstained", "no", [cite()]), (6, "error", None, None), (7, None, None, None), (8, "answered", "It was 6", [cite(index=2, value="")])])
    s = scoring.score_numeric(F.col("status"), F.col("answer"), F.col("citations"), F.lit("2019-01-01"), F.lit(5).cast("decimal(38,10)"), F.lit("revenue"))
    got = {r.id: (r.s.verdict, r.s.flags) for r in df.select("id", s.alias("s")).collect()}
    assert got == {1: ("correct", ["look_ahead"]), 2: ("wrong_metric", ["look_ahead"]), 3: ("correct_text_only", ["look_ahead", "uncited_number"]), 4: ("correct_text_only", ["uncited_number"]), 5: ("abstained_wrongly", ["citation_invalid", "look_ahead"]), 6: ("error", []), 7: ("not_run", []), 8: ("wrong_value", ["citation_invalid", "look_ahead"])}
    c = scoring.score_computed(F.col("status"), F.col("answer"), F.col("citations"), F.lit(None).cast("string"), F.lit(5).cast("decimal(38,10)"), F.lit(False))
    got = {r.id: (r.s.verdict, r.s.flags) for r in df.select("id", c.alias("s")).collect()}
    assert got[1] == ("correct", []) and got[4] == ("correct", ["uncited_number"]) and got[8] == ("wrong_value", ["citation_invalid"])


def test_several_figures_are_attributed(spark):
    a = answers(spark, [(1, "answered", "A 5, B 7", None), (2, "answered", "A 5 only", None), (3, "answered", "nothing", [cite()]), (4, "answered", "nothing", None), (5, "abstained", "5 and 7", None)]).withColumn("as_of", F.lit(None).cast("string"))
    v = spark.createDataFrame([(i, t, x) for i in range(1, 6) for t, x in (("A", Decimal(5)), ("B", Decimal(7)))], "id int, label string, value decimal(38,10)")
    assert rows(scoring.score_multi(a, "id", v).select("id", "verdict", "correct")) == [(1, "correct", 2), (2, "partial_multi", 1), (3, "partial_multi", 1), (4, "wrong_value", 0), (5, "abstained_wrongly", 2)]


def test_refusals_and_sections(spark):
    df = spark.createDataFrame([(1, "abstained", "no", "r"), (2, "abstained", "it was 31.5%", "x"), (3, "clarification_needed", "which?", None), (4, "answered", "5", None), (5, "error", None, None), (6, None, None, None), (7, "abstained", "fiscal 2024 and 2024-11-01", "r"), (8, "abstained", "about 5 million", "r")], "id int, status string, answer string, reason string").coalesce(1)
    s = scoring.score_abstain(F.col("status"), F.col("answer"), F.array().cast(scoring.CITATION), F.lit(None).cast("string"), F.col("reason"), F.lit("r"), F.col("id") == 3)
    got = {r.id: (r.s.verdict, r.s.flags) for r in df.select("id", s.alias("s")).collect()}
    assert got == {1: ("correct_abstain", []), 2: ("wrong_abstain_reason", ["abstention_with_number"]), 3: ("correct_abstain", []), 4: ("answered_wrongly", []), 5: ("error", []), 6: ("not_run", []), 7: ("correct_abstain", []), 8: ("correct_abstain", ["abstention_with_number"])}
    t = spark.createDataFrame([(["x", "Item 1A: Risk Factors", "item_7_mda__2"],), (["x"] * 5 + ["item_7_mda"],), ([],), (None,)], "c array<string>").coalesce(1)
    assert [r[0] for r in t.select(scoring.section_rank(F.col("c"), F.array(F.lit("item_1a_risk_factors__3"), F.lit("item_7_mda")))).collect()] == [2, None, None, None]
    n = spark.createDataFrame([(" Items 10-14: Corporate Governance__4",), (None,), ("other",)], "s string").coalesce(1)
    assert [r[0] for r in n.select(scoring.normal_section(F.col("s"))).collect()] == ["item_governance", "", "other"]


def test_gold_values_against_an_oracle(spark):
    g = spark.createDataFrame([("a", Decimal(5)), ("b", Decimal(6)), ("c", Decimal(7))], "k string, value decimal(38,10)")
    o = spark.createDataFrame([("a", Decimal(5)), ("a", Decimal(9)), ("b", Decimal(9))], "k string, value decimal(38,10)")
    assert [(r.k, r.verified_by) for r in scoring.gold_oracle(g, o, ["k"]).orderBy("k").collect()] == [("a", "companyfacts"), ("b", "mismatch"), ("c", "auto")]
    with pytest.raises(Exception, match="differs from the oracle"):
        scoring.gold_oracle(g, o, ["k"], strict=True).collect()


def test_keyed_updates_and_primary_documents(spark):
    s = spark.createDataFrame([("1", "x", 1), ("2", "y", 2), (None, "z", 3)], "k string, v string, n int")
    c = spark.createDataFrame([("1", None), ("9", "new")], "k string, v string")
    assert rows(upkeep.update_by_key(s, c, "k")) == [("1", None, 1), ("2", "y", 2), (None, "z", 3)]
    f = spark.createDataFrame([("a", "primary-document.html", 1001), ("a", "big.htm", 9999), ("b", "index.html", 9999), ("b", "x.htm", 1500), ("b", "y.HTML", 1600), ("c", "x.htm", 900), ("d", None, None)], "accession string, name string, size int")
    assert rows(upkeep.primary_documents(f)) == [("a", "primary-document.html"), ("b", "y.HTML"), ("c", None), ("d", None)]
