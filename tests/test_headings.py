"""Sections of small filings, headings hidden in tables, and transforms of tagged texts."""

from pyspark.sql import functions as F

from ledgerline.functions import transforms
from ledgerline.operators import headings
from ledgerline.sources.tables import filing_lines

PROSE = "The company describes the matter at length in this paragraph of its annual report. " * 4
CONTENTS = ["Item 1. Business 3", "Item 1A. Risk Factors 10", "Item 7. Management's Discussion 30"]


def names(lines):
    return [(i, n) for i, n, _ in headings.boundaries(lines)]


def test_contents_pages_lose_to_headings_with_prose():
    lines = [*CONTENTS, "", "Item 1. Business", PROSE, "PART I - ITEM 1A. RISK FACTORS", "See below.", PROSE, "Item 7. Management's Discussion", PROSE, *[""] * 20]
    assert names(lines) == [(4, "item_1_business"), (6, "item_1a_risk_factors"), (9, "item_7_mda")]


def test_references_and_mentions_are_no_headings():
    lines = ["Refer to Part I, Item 1A: Risk Factors on pages 10-37", "Risks described elsewhere in this Item 1A. Risk Factors", "We discuss Item 7. Management's Discussion too", "Item 1. Business", PROSE, *["x"] * 60]
    assert names(lines) == [(3, "item_1_business")]


def test_headings_split_over_lines():
    lines = ["ITEM 1. B", "USINESS", PROSE, "Item 1A.", "", "Risk Factors", PROSE, *["x"] * 40]
    assert names(lines) == [(0, "item_1_business"), (3, "item_1a_risk_factors")]


def test_a_pointer_is_no_prose():
    pointer = "The discussion appears on pages 44-115 of this report and " + "is quoted there in full, " * 12
    assert headings.candidates(["Item 7. Management's Discussion", pointer, *["x"] * 40])[0][3] is False
    assert headings.candidates(["Item 7. Management's Discussion", PROSE, *["x"] * 40])[0][3] is True


def test_statements_take_the_last_heading_like_line_of_the_zone():
    lines = ["Consolidated Balance Sheets", *["x"] * 20, "Consolidated Balance Sheets", *["x"] * 20, "CONSOLIDATED BALANCE SHEETS", *["x"] * 10, "as shown in the consolidated balance sheets of the company, which " + "were audited " * 10, *["x"] * 40]
    assert headings.statements(lines)["fs_balance_sheet"] == 42
    assert headings.statements(["§§ Consolidated Statement of Income", *lines])["fs_income_stmt"] == 0
    assert headings.boundaries([]) == [] and headings.boundaries([""] * 5) == []


def test_tables_leave_their_headings_and_a_placeholder():
    data = "".join(f"<tr><td>Net interest income of year {i}</td><td>{i},000</td></tr>" for i in range(4))
    html = f"<p>Intro</p><table><tr><td></td></tr><tr><td>Consolidated Statement of Income</td><td></td></tr>{data}</table><table><tr><td>Item 1.</td><td>Business</td></tr></table><table><tr><td>Item 7.</td><td>Management's Discussion</td><td>31</td></tr></table><script>x</script><p>End&amp;</p>"
    lines, kept = filing_lines(html, headings.table_heads)
    assert [x for x in lines if x] == ["Intro", "§§ Consolidated Statement of Income", "<<<TABLE_0>>>", "§§ Item 1.Business", "End&"] and len(kept) == 1 and kept[0][2][1] == "0,000"
    assert filing_lines("", headings.table_heads) == ([], [])


def test_sections_of_documents(spark):
    text = "\n".join(["Item 1. Business", PROSE, "Item 1A. Risk Factors", PROSE, *[""] * 30])
    got = headings.filing_sections(spark.createDataFrame([(1, text), (2, None), (3, "")], "d int, t string"), "d", "t").collect()
    assert [(r.d, r.section, r.part, r.line_no, r.until, r.prose) for r in got] == [(1, "item_1_business", "item_1_business", 0, 2, True), (1, "item_1a_risk_factors", "item_1a_risk_factors", 2, 34, True)]


def test_tagged_texts(spark):
    cases = [
        ("ixt:date-monthname-day-year-en", "September 28, 2024", "2024-09-28", False), ("ixt:datemonthnamedayyearen", "Sept 28 2024", "Sept 28 2024", True), ("ixt:datemonthdayyearen", "Dec. 1, 2020", "2020-12-01", False), ("ixt:date-month-day-year", "9/8/24", "2024-09-08", False),
        ("ixt:dateyearmonth", "2024-9", "2024-09", False), ("ixt:fixed-true", "anything", "true", False), ("ixt:booleanfalse", None, "false", False), ("ixt-sec:boolballotbox", "☐", "false", False), ("ixt-sec:boolballotbox", "☒", "true", False), ("ixt-sec:exchnameen", " NASDAQ ", "NASDAQ", False), (None, "  ", None, False), ("ixt:date-month-day-year", "", None, True),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "f string, t string").coalesce(1)
    assert [(r[0].value, r[0].failed) for r in df.select(transforms.tagged_text(F.col("f"), F.col("t"))).collect()] == [c[2:] for c in cases]
