"""Row helpers shared by the tests."""

import datetime as dt
import os
from decimal import Decimal

DATA = "/root/testdata/sf0.001"
FACTS = "id bigint, accession string, ticker string, concept string, value decimal(38,10), value_text string, unit string, decimals string, scale_raw string, sign_raw string, period_type string, start_date date, end_date date, context_id string, source_doc string, element_id string"
FILINGS = "accession string, ticker string, cik bigint, entity_name string, form_type string, period_end date, fiscal_label int, filing_date date, collection_name string, facts_built_at string, amends string"
A, B, C = "0000000001-20-000001", "0000000001-20-000002", "0000000001-21-000003"


def day(s):
    return dt.date.fromisoformat(s) if s else None


def fact(i, value, decimals="0", acc=A, concept="Assets", unit="USD", start=None, end="2019-12-31", text=None, ctx="c", src="d", el="e"):
    return (i, acc, "T", concept, None if value is None else Decimal(str(value)), text, unit, decimals, None, None, "instant", day(start), day(end), ctx, src, el)


def facts(spark, rows):
    return spark.createDataFrame(rows, FACTS)


def filing(acc, form="10-K", label=2019, filed="2020-02-01", amends=None, cik=1, ticker="T", end="2019-12-31"):
    return (acc, ticker, cik, "N", form, day(end), label, day(filed), None, None, amends)


def filings(spark, rows):
    return spark.createDataFrame(rows, FILINGS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con
