"""The history is the same whether small sides are sent around or shuffled."""

import random

from ledgerline import runtime
from ledgerline.functions.precision import half_unit
from ledgerline.operators import history
from ledgerline.operators.statements import half
from tests.support import fact, facts, filing, filings, rows
from pyspark.sql import functions as F


def test_the_plan_does_not_depend_on_the_broadcast_limit(spark, monkeypatch):
    r = random.Random(3)
    accs = [f"0000000001-{20 + i % 3}-{i:06d}" for i in range(9)]
    f = filings(spark, [filing(a, r.choice(["10-K", "10-K/A"]), 2019, f"2020-0{1 + i % 4}-01", None, 1 + i % 2) for i, a in enumerate(accs)])
    data = [fact(i, r.randrange(5) * 400, r.choice(["-3", "0", "INF", None]), acc=r.choice(accs), concept=r.choice(["X", "Y", "Z"]), end=r.choice(["2019-12-31", None])) for i in range(160)]
    df = facts(spark, data)
    sent = rows(history.restated_numbers(df, f))
    monkeypatch.setattr(runtime, "BROADCAST_LIMIT_BYTES", -1)
    assert rows(history.restated_numbers(df, f)) == sent and len(sent) > 5


def test_half_units_of_one_rank_and_of_a_column_are_the_same(spark):
    ranks = [None, 10000, 11, 10, 9, 0, -3, -25, -26, -27, -30]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(ranks)], "i int, r int").select("i", half_unit(F.col("r")).alias("h")).orderBy("i").collect()
    assert [x.h for x in got] == [half(r) for r in ranks]
