"""Problem 2 on small fixtures and against its greedy definition."""

import random

import pytest

from ledgerline import runtime
from ledgerline.llm import survivors
from ledgerline.operators.statements import statements
from tests.support import fact, facts, rows
from tests.test_training_operators import brute_groups


def random_facts(seed, n=60, span=4000):
    r = random.Random(seed)
    out = []
    for i in range(n):
        d = r.choice(["-3", "-2", "0", "INF", None, " -3", ""])
        v = None if r.random() < 0.1 else r.randrange(span)
        out.append(fact(i, v, d, text=None if v is not None else r.choice(["x", "y"]), unit=r.choice(["USD", None]), ctx=r.choice([None, " ", f"c{i}"])))
    return out


@pytest.mark.parametrize("hot", [20_000, 3, 1])
def test_survivors_equal_the_greedy_definition_however_hot_groups_are_cut(spark, monkeypatch, hot):
    monkeypatch.setattr(runtime, "BROADCAST_LIMIT_BYTES", -1 if hot == 1 else 48 << 20)
    data = random_facts(5)
    df = statements(facts(spark, data))
    got = survivors.representatives(df, ["accession", "unit", "start_date", "end_date", "concept"], ["context_id"], hot)
    expected = set()
    by = {r["id"]: r for r in df.collect()}
    for unit in ("USD", None):
        for g in brute_groups([(r["id"], r["rank"], r["value"], r["value_text"]) for r in by.values() if r["unit"] == unit]):
            if len(g) > 1:
                order = sorted(g, key=lambda i: (by[i]["rank"] is None, -(by[i]["rank"] or 0), i))
                expected.add((order[0], len(g), next((by[i]["context_id"] for i in order if by[i]["context_id"]), None)))
    assert {tuple(r) for r in got.collect()} == expected


def test_survivors_complete_blank_fields_and_leave_nil_facts_out(spark):
    f = facts(spark, [fact(1, 100, "0", ctx=None, src=" ", el=None), fact(2, 100, "-3", concept="us-gaap:Assets", ctx="c2", src="d2"), fact(3, 100, None, el="e3"), fact(4, None), fact(5, 700, "0"), fact(6, 700, "0", end=None), fact(7, 700, "0", end=None)])
    assert rows(survivors.duplicate_facts(f)) == [(1, "c2", "d2", "e"), (6, "c", "d", "e")]
    assert rows(survivors.duplicate_facts(facts(spark, []))) == []


@pytest.mark.parametrize("hot", [20_000, 1])
def test_fields_of_repeated_statements_come_from_the_next_best_record_that_has_them(spark, hot):
    data = [fact(1, 100, "-1", ctx=None, src=None), fact(5, 105, "-1", ctx="B", src=None), fact(10, 100, "-1", ctx="A", src="d10"), fact(3, 100, "-2", ctx="C", src="d3"), fact(11, 105, "-1", ctx="D", src="d11"), fact(2, 100, "0", ctx=None, src=None), fact(12, 100, "0", ctx=None, src=None)]
    df = statements(facts(spark, data))
    got = survivors.representatives(df, ["accession", "concept"], ["context_id", "source_doc"], hot)
    assert rows(got) == [(2, 7, "B", "d10")]


def test_leftovers_are_judged_again(spark):
    f = facts(spark, [fact(1, 1000, "INF"), fact(2, 1400, "-3"), fact(3, 5000, "-3"), fact(4, 5900, "-3"), fact(5, 9000, None), fact(6, 9000, None), fact(7, 9001, None)])
    assert [r[0] for r in rows(survivors.duplicate_facts(f))] == [1, 3, 5]


def test_learned_precedence_finds_the_latest_value(spark):
    seen = [(c, "cat", v, f"20{10 + t}-01-01") for c in range(6) for t, v in enumerate(["small", "medium", "large", "huge"])] + [(7, "cat", "huge", "2010-01-01"), (7, "cat", "small", "2011-01-01"), (8, "cat", None, "2012-01-01")]
    df = spark.createDataFrame(seen, "cik int, a string, v string, t string")
    order = survivors.learn_precedence(df, ["cik"], "a", "v", "t")
    assert {(r.older, r.newer) for r in order.collect()} == {("small", "medium"), ("medium", "large"), ("large", "huge"), ("huge", "small")}
    g = spark.createDataFrame([(1, "cat", "small"), (1, "cat", "medium"), (2, "cat", "medium"), (2, "cat", "large"), (3, "cat", "other"), (3, "cat", None)], "g int, a string, v string")
    # all four values lie on a cycle, so none of them precedes another: the least counts
    assert rows(survivors.latest_values(g, ["g"], "a", "v", order)) == [(1, "cat", "medium"), (2, "cat", "large"), (3, "cat", "other")]
    chain = order.filter("older <> 'huge'")
    assert rows(survivors.latest_values(g, ["g"], "a", "v", chain)) == [(1, "cat", "medium"), (2, "cat", "large"), (3, "cat", "other")]


def test_precedence_reaches_over_values_a_group_does_not_hold(spark):
    order = spark.createDataFrame([("x", v, w, 2) for v, w in zip("ZYXWVUTS", "YXWVUTSR")], "a string, older string, newer string, support bigint")
    g = spark.createDataFrame([(1, "x", "Z"), (1, "x", "R"), (2, "x", "Y"), (2, "x", "T"), (2, "x", "q"), (3, "y", "Z"), (3, "y", "R")], "g int, a string, v string")
    assert rows(survivors.latest_values(g, ["g"], "a", "v", order)) == [(1, "x", "R"), (2, "x", "T"), (3, "y", "R")]
    assert survivors.latest_values(g.limit(0), ["g"], "a", "v", order).count() == 0
    assert rows(survivors.latest_values(g, ["g"], "a", "v", order.limit(0))) == [(1, "x", "R"), (2, "x", "T"), (3, "y", "R")]


def test_a_chain_of_overlapping_intervals_passes_as_a_stream(spark):
    data = [fact(i, 40 * i, "-2", ctx=None if i % 3 else f"c{i}") for i in range(400)]
    got = survivors.representatives(statements(facts(spark, data)), ["accession"], ["context_id"], 10)
    want = survivors.fold([(i, -2, r["value"], None, 1, None, r["context_id"]) for i, r in enumerate(sorted(statements(facts(spark, data)).collect(), key=lambda r: r["id"]))])
    assert rows(got) == sorted([tuple(x) for x in want if x[1] > 1], key=repr)
