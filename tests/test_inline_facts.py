"""Facts of inline documents that are joined where they are read."""

import __spark_entry__ as entry
from ledgerline.sources import inline
from tests.support import DATA, rows

CONTEXT = '<xbrli:context id="{i}"><xbrli:entity><xbrli:identifier>7</xbrli:identifier>{d}</xbrli:entity><xbrli:period>{p}</xbrli:period></xbrli:context>'
SPAN = "<xbrli:startDate>2019-01-01</xbrli:startDate><xbrli:endDate>2019-12-31</xbrli:endDate>"
UNIT = '<xbrli:unit id="{i}">{m}</xbrli:unit>'
FACT = '<ix:nonFraction name="{n}" contextRef="{c}" unitRef="{u}" format="ixt:num-dot-decimal">{v}</ix:nonFraction>'
DOCS = [
    # facts before their definitions, an id defined twice, a rate, no unit, an unknown context and unit, a nested and a nil fact
    FACT.format(n="early", c="c", u="u", v="1") + CONTEXT.format(i="c", d='<xbrldi:explicitMember dimension="a">m</xbrldi:explicitMember>', p="<xbrli:instant>2019-12-31</xbrli:instant>") + CONTEXT.format(i="c", d="", p=SPAN)
    + UNIT.format(i="u", m="<xbrli:measure>iso:USD</xbrli:measure>") + UNIT.format(i="u", m="<xbrli:measure>iso:EUR</xbrli:measure>"),
    CONTEXT.format(i="s", d="", p=SPAN) + UNIT.format(i="r", m="<xbrli:divide><xbrli:unitNumerator><xbrli:measure>USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide>")
    + UNIT.format(i="e", m="") + FACT.format(n="rate", c="s", u="r", v="2.5") + FACT.format(n="bare", c="s", u="e", v="3") + FACT.format(n="lost", c="x", u="y", v="4") + '<ix:nonNumeric name="text" contextRef="s">with <ix:nonFraction name="in" contextRef="s" unitRef="r">5</ix:nonFraction></ix:nonNumeric><ix:nonFraction name="nil" contextRef="s" unitRef="r" xsi:nil="true"></ix:nonFraction><p><ix:nonFraction name="open" contextRef="s" unitRef="r">6',
    "no facts", "", None,
]


def test_facts_are_those_of_the_joins(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "id bigint, html string")
    want, got = inline.facts(inline.scan(docs, "id", "html")), inline.scan_facts(docs, "id", "html")
    assert got.columns == want.columns and rows(got) == rows(want) and got.count() == 8


def test_round_trip_keeps_nothing_between_its_steps(spark):
    plan = entry.queries()["inline_roundtrip"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "ExistingRDD" not in plan


def test_documents_of_one_name_keep_their_own_definitions(spark):
    docs = [(1, CONTEXT.format(i="c", d="", p=f"<xbrli:instant>{d}</xbrli:instant>") + FACT.format(n="a", c="c", u="u", v=v)) for d, v in (("2018-12-31", 1), ("2019-12-31", 2))]
    got = inline.scan_facts(spark.createDataFrame(docs, "id bigint, html string"), "id", "html")
    assert sorted((str(r["end_date"]), float(r["value"])) for r in got.select("end_date", "value").collect()) == [("2018-12-31", 1.0), ("2019-12-31", 2.0)]
