"""Problems 1, 3, 5 and 6 on small fixtures: defined results for nulls, ties, repetitions and empty tables."""

import random
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import asof, cells, history, reconcile, wide
from ledgerline.operators.statements import half, statements
from ledgerline.plans import training, training_sql
from tests.support import A, B, C, day, fact, facts, filing, filings, rows


def outcomes(spark, data):
    return spark.createDataFrame(data, "outcome_id bigint, as_of string, cik bigint, fiscal_label int, extra string")


def test_filing_in_force_follows_amendments_and_days(spark):
    f = filings(spark, [filing(A), filing(A), filing(B, "10-K/A", 2020, "2020-03-01", A.replace("-", "")), filing(C, "10-K/A", 2025, "2020-04-01", f" {B} ")])
    o = outcomes(spark, [(1, "2020-01-31", 1, 2019, ""), (2, "2020-02-01", 1, 2019, ""), (3, "2020-03-01T00:00:00Z", 1, 2019, ""), (4, " 2021-01-01 ", 1, 2019, ""), (5, "soon", 1, 2019, ""), (6, None, 1, 2019, ""), (7, "2021-01-01", None, 2019, ""), (4, " 2021-01-01 ", 1, 2019, ""), (8, "2021-02-31", 1, 2019, ""), (9, "2021-01-01", 1, 2025, "")])
    assert rows(asof.filing_in_force(o, f)) == [(2, A), (3, B), (4, C)]


def test_amendment_beats_original_of_the_same_day_and_cycles_keep_their_label(spark):
    f = filings(spark, [filing(A, filed="2020-02-01"), filing(B, "10-K/A", 2018, "2020-02-01", A)])
    assert rows(asof.filing_in_force(outcomes(spark, [(1, "2020-02-01", 1, 2019, "")]), f)) == [(1, B)]
    cyc = filings(spark, [filing(A, "10-K/A", 2019, "2020-02-01", B), filing(B, "10-K/A", 2018, "2020-03-01", A)])
    assert rows(asof.filing_in_force(outcomes(spark, [(1, "2020-05-01", 1, 2019, ""), (2, "2020-05-01", 1, 2018, "")]), cyc)) == [(1, A), (2, B)]


def test_filing_in_force_of_empty_tables(spark):
    none, some = filings(spark, []), filings(spark, [filing(A)])
    assert rows(asof.filing_in_force(outcomes(spark, [(1, "2020-02-01", 1, 2019, "")]), none)) == []
    assert rows(asof.filing_in_force(outcomes(spark, []), some)) == []


def test_amendment_chain_of_any_length(spark):
    n = 37
    accs = [f"0000000001-20-{i:06d}" for i in range(n)]
    f = filings(spark, [filing(a, "10-K/A" if i else "10-K", 2019 - i, f"2020-02-{1 + i % 28:02d}", accs[i - 1] if i else None) for i, a in enumerate(accs)])
    got = rows(asof.amendment_roots(asof.listed_filings(f)).select("accession", "root", "depth"))
    assert got == [(a, accs[0], i) for i, a in enumerate(accs) if i]


@pytest.mark.parametrize("split", [None, "month", "year"])
def test_as_known_with_clashing_columns(spark, split):
    ev = spark.createDataFrame([("k", "2020-05-05", 1), ("k", "2020-05-05", 1), ("k", "2019-01-01", 2), (None, "2020-05-05", 3), ("x", "2020-05-05", 4)], "e string, t string, known int").withColumn("t", F.col("t").cast("date"))
    ch = spark.createDataFrame([("k", "2020-05-05", 7), ("k", "2020-05-05", 9), ("k", "2018-01-01", 1), ("k", None, 5)], "e string, t string, v int").withColumn("t", F.col("t").cast("date"))
    got = asof.as_known(ev.withColumnRenamed("known", "id"), ch, ["e"], "t", "t", [F.col("v")], split)
    assert sorted((r.id, r.known.v) for r in got.collect()) == [(1, 9), (1, 9), (2, 1)]


def brute_groups(data):
    """Greedy survivors by definition, over (id, rank, value, text)."""
    out = []
    left = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    while left:
        best, rest, group = left[0], [], [left[0]]
        for r in left[1:]:
            ok = (r[2], r[3]) == (best[2], best[3])
            if not ok and None not in (r[2], best[2], r[1], best[1]):
                ok = abs(r[2] - best[2]) <= half(r[1]) + half(best[1])
            (group if ok else rest).append(r)
        out.append(sorted(r[0] for r in group))
        left = rest
    return out


def test_cells_agree_exactly_when_one_group_holds_all_records(spark):
    data = []
    for s in range(80):
        r = random.Random(s)
        for k in range(r.randrange(1, 4)):
            d = r.choice(["-3", "-2", "0", "INF", None])
            data.append(fact(s * 10 + k, r.randrange(1200) if r.random() < 0.9 else None, d, concept=f"C{s}", text="t", unit=r.choice(["USD", "USD", "EUR"])))
            data[-1] = data[-1][:5] + (None if data[-1][4] is not None else "t",) + data[-1][6:]
    df = statements(facts(spark, data))
    got = {r.concept: r["value"] for r in cells.agreed_cells(df, ["accession", "end_date", "concept"], ["unit", "start_date"]).collect()}
    want = {}
    for c in {x["concept"] for x in df.collect()}:
        g = [r for r in df.collect() if r["concept"] == c]
        groups = brute_groups([(r["id"], r["rank"], r["value"], r["value_text"]) for r in g])
        if len({r["unit"] for r in g}) == 1 and len(groups) == 1:
            want[c] = min(g, key=lambda r: (r["rank"] is None, -(r["rank"] or 0), r["id"]))["value"]
    assert got == want


@pytest.mark.parametrize("cells_at_once", [4_000_000, 1])
def test_wide_table_types_and_conflicts(spark, monkeypatch, cells_at_once):
    monkeypatch.setattr(wide, "BLOCK_ROWS", 1)
    monkeypatch.setattr(wide, "BLOCK_CELLS", cells_at_once)
    data = [fact(1, 5), fact(2, 5, None), fact(3, None, text="2020-01-31", concept="p:Day"), fact(4, None, text="TRUE", concept="Flag"), fact(5, None, text=" a ", concept="Name"), fact(6, 1, concept="Clash"), fact(7, 9, concept="Clash"), fact(8, 3, acc=B), fact(9, 4, acc=None), fact(10, 6, end=None), fact(11, None, text="x", concept="Assets", acc=C)]
    f = facts(spark, data + [fact(100 + i, i, acc=f"z{i:05d}") for i in range(40)])
    found = rows(wide.filled_cells(f).filter("accession not like 'z%'"))
    assert found == sorted([(A, "2019-12-31", c) for c in ("Assets", "Day", "Flag", "Name")] + [(B, "2019-12-31", "Assets"), (C, "2019-12-31", "Assets"), (A, None, "Assets")], key=repr)
    t = wide.wide_table(wide.fact_cells(f), ["accession", "end_date"], "concept", [("Assets", "number"), ("Assets", "text"), ("Day", "date"), ("Flag", "boolean"), ("None", "text")], ["Assets", "Words", "Day", "Flag", "None"])
    assert t.count() == 44 and t.columns[2:] == ["Assets", "Words", "Day", "Flag", "None"] and t.dtypes[2][1] == "decimal(38,10)"


def test_wide_table_columns(spark):
    f = facts(spark, [fact(1, 5), fact(3, None, text="2020-01-31", concept="Day"), fact(4, None, text="TRUE", concept="Flag"), fact(8, 3, acc=B)])
    t = wide.wide_table(wide.fact_cells(f), ["accession", "end_date"], "concept", [("Assets", "number"), ("Day", "date"), ("Flag", "boolean"), ("Gone", "text")])
    got = {r.accession: (r.Assets, str(r.Day), r.Flag, r.Gone) for r in t.collect()}
    assert got == {A: (Decimal(5), "2020-01-31", True, None), B: (Decimal(3), "None", None, None)}
    assert rows(wide.filled_cells(facts(spark, []))) == []


@pytest.mark.parametrize("cells_at_once", [4_000_000, 1])
def test_blocks_hold_every_value_at_its_place(cells_at_once, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(wide, "BLOCK_CELLS", cells_at_once)
    r = random.Random(2)
    data = []
    for e in range(30):
        for a in r.sample(["p", "q", "r", "s", None], r.randrange(1, 5)):
            kind = r.choice(wide.KINDS)
            number = Decimal(r.randrange(-10**30, 10**30)).scaleb(-10) if kind == "number" else None
            text = {"date": f" 20{r.randrange(10, 30)}-01-31", "boolean": r.choice(["TRUE", "false "]), "text": r.choice(["", "x", "\u00e9 "])}.get(kind)
            data.append((None if e == 29 else e, a, kind, number, text))
    cells = pa.table({"e": pa.array([d[0] for d in data]), "a": pa.array([d[1] for d in data]), "kind": pa.array([d[2] for d in data]), "number": pa.array([d[3] for d in data], pa.decimal128(38, 10)), "text": pa.array([d[4] for d in data], pa.string())})
    want = {}
    for e, a, kind, number, text in data:
        want[e, a, kind] = number if kind == "number" else day(text.strip()) if kind == "date" else text.strip().lower() == "true" if kind == "boolean" else text
    got, tables = {}, 0
    for t, meaning in wide.block(cells.slice(3).slice(0), ["e"], "a"):
        tables += 1
        for row in t.to_pylist():
            got |= {(row["e"], *meaning[c]): v for c, v in row.items() if c != "e" and v is not None}
    assert got == {(e, a, k): want[e, a, k] for e, a, k, _, _ in data[3:]} and (tables > 1) == (cells_at_once == 1)


def test_whole_wide_table(spark, tmp_path):
    f = facts(spark, [fact(1, 5), fact(2, None, text="x", concept="Assets", acc=B), fact(3, 7, concept="p:Odd name")])
    cells_ = wide.fact_cells(f)
    wide.write_wide(cells_, ["accession", "end_date"], "concept", str(tmp_path / "w"))
    got = {r["accession"]: r.asDict() for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert got[A]["Assets#number"] == 5 and got[A]["Odd name"] == 7 and got[A]["Assets#text"] is None and got[B]["Assets#text"] == "x"
    assert wide.whole_table(wide.fact_cells(f.limit(0)), ["accession", "end_date"], "concept").columns == ["accession", "end_date"]


def test_history_opens_versions_only_beyond_declared_precision(spark):
    f = filings(spark, [filing(A, filed="2020-02-01"), filing(B, "10-K/A", 2019, "2020-02-01", A), filing(C, filed="2021-02-01", label=2020)])
    data = [fact(1, 1000, "0"), fact(2, 1400, "-3", acc=B), fact(3, 1400, "0", acc=C), fact(4, 7, concept="X"), fact(5, 7, concept="X", acc=C), fact(6, 1, concept="Y", acc=C), fact(7, 5, concept="Y", acc=C), fact(8, 3, acc="0000000009-20-000001"), fact(9, 4, end=None), fact(10, 9, end=None, acc=C)]
    got = rows(history.restated_numbers(facts(spark, data), f))
    assert got == sorted([(1, "Assets", "2019-12-31", A, C), (1, "Assets", "2019-12-31", C, ""), (1, "X", "2019-12-31", A, ""), (1, "Assets", None, A, C), (1, "Assets", None, C, "")], key=repr)
    assert rows(history.restated_numbers(facts(spark, []), f)) == []
    assert rows(history.restated_numbers(facts(spark, data), filings(spark, []))) == []


def test_history_compares_with_the_opener_not_the_neighbour(spark):
    accs = [f"0000000001-20-{i:06d}" for i in range(5)]
    f = filings(spark, [filing(a, filed=f"2020-03-0{i + 1}") for i, a in enumerate(accs)])
    data = [fact(i, v, "-3", acc=a) for i, (a, v) in enumerate(zip(accs, [1000, 1900, 2800, 3700, 1000]))]
    got = [(r[3], r[4]) for r in rows(history.restated_numbers(facts(spark, data), f))]
    assert got == [(accs[0], accs[2]), (accs[2], accs[4]), (accs[4], "")]


def test_snapshot_differencing_classifies(spark):
    s = spark.createDataFrame([("k", 1, 5), ("k", 2, 5), ("k", 3, 6), (None, 1, 1)], "k string, n int, v int")
    d = history.difference_snapshots(s, ["k"], "n", lambda a, b: a["v"] == b["v"])
    assert rows(d.select("k", "n", "change")) == sorted([("k", 1, "inserted"), ("k", 3, "changed"), ("k", 4, "deleted"), (None, 1, "inserted"), (None, 2, "deleted")], key=repr)


def test_copies_are_compared_field_by_field(spark):
    cols = "a string, g string, value int, matched string, extra int"
    left = spark.createDataFrame([("1", "x", 1, "m", 9), ("1", "x", 1, "m", 8), ("2", "x", 1, "m", 0), ("3", "x", None, "m", 0), ("4", "x", None, None, 0), ("5", "x", 1, "m", 0), (None, "x", 1, "m", 0)], cols)
    right = spark.createDataFrame([("1", "x", 1, "m", 1), ("3", "x", 2, "q", 0), ("4", "x", None, None, 0), ("5", "x", 1, None, 0), ("6", "x", 1, "m", 0), (None, "x", 1, "m", 5)], cols)
    got = reconcile.compare_copies(left, right, ["a", "g"], ["value", "matched"], ("only_l", "only_r"))
    assert rows(got) == sorted([("2", "x", "only_l"), ("3", "x", "value"), ("3", "x", "matched"), ("5", "x", "matched"), ("6", "x", "only_r")], key=repr)
    assert rows(reconcile.compare_copies(left.limit(0), right.limit(0), ["a", "g"], ["value"], ("l", "r"))) == []


def test_a_key_stated_in_several_ways(spark):
    cols = "a string, value int"
    left = spark.createDataFrame([("1", 1), ("1", 2)], cols)
    right = spark.createDataFrame([("1", 1)], cols)
    assert rows(reconcile.compare_copies(left, right, ["a"], ["value"], ("l", "r"))) == [("1", "value")]


def test_every_statement_of_a_key_is_compared(spark):
    cols = "a string, value int, matched string"
    left = spark.createDataFrame([("1", 1, "m"), ("1", 2, "n"), ("2", 1, "m"), ("2", 2, None), ("3", 1, "m"), ("3", 2, "m"), ("4", 1, "m")], cols)
    right = spark.createDataFrame([("1", 1, "n"), ("2", 1, "m"), ("2", 2, None), ("4", 1, "m"), ("5", 1, "m"), ("5", 1, None), ("5", 1, None)], cols)
    got = reconcile.compare_copies(left, right, ["a"], ["value", "matched"], ("l", "r"))
    assert rows(got) == sorted([("1", "matched"), ("1", "value")] + [("2", "matched"), ("2", "value")] * 2 + [("3", "l")] * 2 + [("5", "r")] * 2)


def test_crosscheck_of_keys_stated_in_several_ways_equals_its_statement(spark, tmp_path):
    r = random.Random(6)
    data = []
    for k in range(40):
        for side in ("ours", "companyfacts"):
            for _ in range(r.randrange(5)):
                v, ours = r.choice([1, 2, 3, None]), side == "ours"
                data.append((side, f"0000000001-20-{k:06d}", "g", r.choice(["Assets", "us-gaap:Assets", "us-gaap_Liabilities", None]), float(v) if ours and v else None, f"+{v}.0" if v and not ours else None))
    spark.createDataFrame(data, "side string, accession string, concept_group string, matched_concept string, our_value_usd double, companyfacts_value string").coalesce(1).write.parquet(f"{tmp_path}/ixbrl_crosscheck.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW ixbrl_crosscheck AS SELECT * FROM '{tmp_path}/ixbrl_crosscheck.parquet/*.parquet'")
    assert rows(training.p6_found(spark, str(tmp_path))) == sorted(con.sql(training_sql.SQL["p6_found"]).fetchall(), key=repr)


def test_crosscheck_spellings(spark):
    cols = "side string, ticker string, fiscal_year int, accession string, concept_group string, matched_concept string, our_value_usd double, companyfacts_value string"
    def pair(i, ours, theirs, ca="Assets", cb="us-gaap_Assets"):
        return [("ours", "T", 1, f"0000000001-20-{i:06d}", "g", ca, ours, None), ("companyfacts", None, 2, f"000000000120{i:06d}", "g", cb, None, theirs)]
    data = pair(1, 1.8168e10, "1.8168E10") + pair(2, -5e6, "(5,000,000)") + pair(3, 7.0, " +7.0 ") + pair(4, 7.0, "8") + pair(5, None, "8") + pair(6, 1.0, None) + pair(7, 2.0, "2", "us-gaap:Assets ", "Liabilities")
    a, b = reconcile.crosscheck_sides(spark.createDataFrame(data, cols))
    got = rows(reconcile.compare_copies(a, b, ["accession", "concept_group"], ["value", "matched_concept"], ("only_ours", "only_companyfacts")))
    assert [(r[0][-1], r[2]) for r in got] == [("4", "value"), ("5", "value"), ("6", "value"), ("7", "matched_concept")]
