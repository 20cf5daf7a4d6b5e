"""Catalog of filings: eligibility, selection, amendment and collection links, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ANNUAL_FORMS = ("10-K", "10-K/A")


def is_amendment(form: Column) -> Column:
    return F.upper(form).like("%/A")


def eligible(filings: DataFrame, as_of: str | None) -> DataFrame:
    """Filings public on ``as_of``; a blank or missing day sets no bound, a malformed one raises."""
    if as_of is None or not as_of.strip():
        return filings
    return filings.filter(F.col("filing_date") <= F.lit(as_of.strip()).cast("date"))


def unique_filings(filings: DataFrame) -> DataFrame:
    """One row per accession of a listing that repeats some; ingest columns take their greatest value."""
    rest = [c for c in filings.columns if c != "accession"]
    return filings.groupBy("accession").agg(*[F.max(c).alias(c) for c in rest])


def newest_first(filings: DataFrame) -> DataFrame:
    """``position`` of each filing among its ticker's, newest period and then newest filing first."""
    order = Window.partitionBy("ticker").orderBy(F.desc("period_end"), F.desc("filing_date"), F.desc("accession"))
    return filings.withColumn("position", F.row_number().over(order))


def filings_to_ingest(filings: DataFrame, limit: int, match: str, include_amendments: bool = True) -> DataFrame:
    """The newest ``limit`` originals of each ticker and the amendments that share ``match`` with one of them.

    ``match`` is "fiscal_label" for text ingestion and "period_end" for the facts build.
    """
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("period_end"), F.desc("filing_date"), F.desc("accession")))
    kept = filings.filter(~is_amendment(F.col("form_type"))).withColumn("__r", rank).filter(F.col("__r") <= limit).drop("__r")
    if not include_amendments:
        return kept
    amended = filings.filter(is_amendment(F.col("form_type"))).join(kept.select("ticker", match).distinct(), ["ticker", match], "left_semi")
    return kept.unionByName(amended)


def link_amendments(filings: DataFrame) -> DataFrame:
    """(accession, amends): amendments with the earliest filed original of their ticker and period, null if none."""
    first = filings.filter(~is_amendment(F.col("form_type"))).groupBy("ticker", "period_end").agg(F.min(F.struct("filing_date", "accession")).alias("__o"))
    amendments = filings.filter(is_amendment(F.col("form_type"))).select("accession", "ticker", "period_end")
    return amendments.join(first, ["ticker", "period_end"], "left").select("accession", F.col("__o.accession").alias("amends"))


def collection_owner(filings: DataFrame, collections: DataFrame) -> DataFrame:
    """(collection_name, accession): the filing that owns each ``ticker_year`` collection, null for orphans.

    Originals own before amendments never do; the earliest filed original of (ticker, fiscal_label) counts.
    """
    named = collections.select("collection_name", F.upper(F.regexp_extract("collection_name", r"^([A-Za-z.]+)_(\d{4})$", 1)).alias("ticker"), F.regexp_extract("collection_name", r"^([A-Za-z.]+)_(\d{4})$", 2).try_cast("int").alias("fiscal_label"))
    originals = filings.filter(~is_amendment(F.col("form_type"))).groupBy("ticker", "fiscal_label").agg(F.min(F.struct("filing_date", "accession")).alias("__o"))
    return named.join(originals, ["ticker", "fiscal_label"], "left").select("collection_name", F.col("__o.accession").alias("accession"))


def link_report(filings: DataFrame, collections: DataFrame) -> DataFrame:
    """(kind, n): linked, already, orphan collections and unindexed originals, by a full outer join.

    Unindexed originals that still name a collection are ``cleared``: the store no longer holds it.
    """
    owners = collection_owner(filings, collections)
    had = filings.filter("collection_name is not null").select("accession", F.col("collection_name").alias("had"))
    originals = filings.filter(~is_amendment(F.col("form_type"))).select("accession").distinct()
    side = owners.filter("accession is not null").join(had, "accession", "left").groupBy("accession").agg(F.bool_or(F.coalesce(F.col("had") == F.col("collection_name"), F.lit(False))).alias("same"))
    joined = originals.withColumn("listed", F.lit(1)).join(side, "accession", "full_outer")
    joined = joined.join(had.select("accession", F.lit(True).alias("named")).distinct(), "accession", "left")
    kind = F.when(F.col("same").isNull(), F.when(F.col("named"), "cleared").otherwise("unindexed")).when(F.col("same"), "already").otherwise("linked")
    orphans = owners.filter("accession is null").select(F.lit("orphan").alias("kind"))
    return joined.select(kind.alias("kind")).unionByName(orphans).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def resolve_period(filings: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, ticker, fiscal_label?, as_of?) with the newest filing that was public.

    Without a label the ticker's greatest public label counts. Requests without one are left out.
    """
    r = requests.alias("r").join(filings.alias("f"), F.upper("r.ticker") == F.upper("f.ticker"))
    r = r.filter((F.col("r.as_of").isNull() | (F.col("f.filing_date") <= F.col("r.as_of"))) & (F.col("r.fiscal_label").isNull() | (F.col("r.fiscal_label") == F.col("f.fiscal_label"))))
    return r.groupBy("r.request_id").agg(F.max_by("f.accession", F.struct("f.fiscal_label", "f.filing_date", "f.accession")).alias("accession"), F.max("f.fiscal_label").alias("fiscal_label"))


def catalog_stats(filings: DataFrame) -> DataFrame:
    return filings.agg(F.count_distinct("accession").alias("filings"), F.count_distinct(F.when(is_amendment(F.col("form_type")), F.col("accession"))).alias("amendments"), F.count_distinct("ticker").alias("tickers"), F.count_distinct("collection_name").alias("collections"))


def upsert(stored: DataFrame, incoming: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Insert or replace rows by ``key``; columns in ``keep`` are never touched by an update.

    Both sides must be unique by key. Nulls of an incoming row overwrite as values do.
    """
    s, n = stored.alias("s"), incoming.alias("n")
    both = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer")
    fresh = F.col(f"n.{key}").isNotNull()
    cols = [F.coalesce(f"n.{key}", f"s.{key}").alias(key)]
    for c in stored.columns:
        if c != key:
            cols.append((F.coalesce(f"s.{c}", F.when(F.col(f"s.{key}").isNull(), F.col(f"n.{c}"))) if c in keep else F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}"))).alias(c))
    return both.select(*cols)


def replace_rows(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """All stored rows whose keys don't occur among ``incoming``, and all incoming rows."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


#: The part of a registry page that is read.
PAGE = "struct<cik: string, name: string, tickers: array<string>, filings: struct<recent: struct<form: array<string>, accessionNumber: array<string>, reportDate: array<string>, filingDate: array<string>, primaryDocument: array<string>>>>"


def read_submissions(documents: DataFrame, content: str) -> DataFrame:
    """(ticker, cik, entity_name, form, accession, report, filed, primary) of registry pages as JSON text, the lists still parallel.

    Pages of older filings hold the lists alone; they carry no name and no ticker of their own. Texts
    that are no JSON give no row. A page without a ticker has a null one.
    """
    j = documents.select(F.from_json(F.col(content), PAGE).alias("p")).filter("p.filings.recent is not null")
    r = F.col("p.filings.recent")
    return j.select(F.upper(F.get("p.tickers", F.lit(0))).alias("ticker"), F.col("p.cik").try_cast("bigint").alias("cik"), F.col("p.name").alias("entity_name"), r.getField("form").alias("form"), r.getField("accessionNumber").alias("accession"), r.getField("reportDate").alias("report"), r.getField("filingDate").alias("filed"), r.getField("primaryDocument").alias("primary"))


def submission_rows(pages: DataFrame) -> DataFrame:
    """Annual filings out of registry pages whose ``form``, ``accession``, ``report``, ``filed`` and, if present, ``primary`` are parallel arrays.

    The arrays are zipped to the length of the shortest of the first four; rows without a report or filing date are dropped.
    """
    lists = ["form", "accession", "report", "filed"]
    n = F.greatest(F.least(*[F.coalesce(F.size(c), F.lit(0)) for c in lists]), F.lit(0))
    more = ["primary"] if "primary" in pages.columns else []
    zipped = F.arrays_zip(*[F.slice(c, 1, n).alias(c) for c in lists], *[F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, n).alias(c) for c in more])
    rows = pages.select("ticker", "cik", F.inline(zipped)).toDF("ticker", "cik", "form_type", "accession", "report", "filed", *(["primary_doc"] if more else []))
    dated = rows.select("ticker", "cik", "form_type", "accession", F.col("report").try_cast("date").alias("period_end"), F.col("filed").try_cast("date").alias("filing_date"), *(["primary_doc"] if more else []))
    return dated.filter(F.col("form_type").isin(*ANNUAL_FORMS) & F.col("period_end").isNotNull() & F.col("filing_date").isNotNull()).distinct()


def input_files(xml: Column) -> Column:
    """Distinct .htm/.html names inside <InputFiles>, in order."""
    block = F.regexp_extract(xml, r"(?is)<InputFiles>(.*?)</InputFiles>", 1)
    names = F.regexp_extract_all(block, F.lit(r"(?i)<File[^>]*>\s*([^<\s]+\.html?)\s*</File>"), F.lit(1))
    return F.array_distinct(names)


def documents_to_fetch(exhibits: Column, primary: Column, limit: int = 8) -> Column:
    """First ``limit`` documents of a filing, the primary one if none is listed."""
    return F.when(F.coalesce(F.size(exhibits), F.lit(0)) > 0, F.slice(exhibits, 1, limit)).otherwise(F.array(primary))


def fiscal_year(header: Column, details_json: Column, accession: Column, fallback: int = 2023) -> Column:
    """Year of a filing: conformed period, else reportDate of the details, else the accession's year less one."""
    period = F.nullif(F.regexp_extract(header, r"CONFORMED PERIOD OF REPORT:\s*(\d{4})", 1), F.lit("")).cast("int")
    detail = F.nullif(F.regexp_extract(F.get_json_object(details_json, "$.reportDate"), r"^(\d{4})", 1), F.lit("")).cast("int")
    yy = F.nullif(F.regexp_extract(accession, r"^\d{10}-(\d{2})-", 1), F.lit("")).cast("int")
    return F.coalesce(period, detail, yy + 1999, F.lit(fallback))


def label_verdict(fiscal_label: Column, said: Column) -> Column:
    """match or mismatch of a label with the year that a filing states, no_dei_label without one, unparsable if it is no date."""
    day = F.trim(said).try_cast("date")
    return F.when(said.isNull(), "no_dei_label").when(day.isNull(), "unparsable").when(F.year(day) == fiscal_label, "match").otherwise("mismatch")
