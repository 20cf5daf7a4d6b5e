"""Upkeep of stores: keyed updates, targets, currency of files, stale rows, fingerprints and run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of section names that are indexed first, and the size below which nothing is split.
PRIORITY = ("risk factors", "md&a", "management's discussion", "business", "income", "balance sheet", "cash flow", "equity", "financial statements")
LEAST_TO_SPLIT = 40
#: Bytes that a document must exceed to be the primary one.
LEAST_DOCUMENT = 1000
PRIMARY_NAMES = ("primary-document.html", "primary-document.htm")


def update_by_key(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Stored rows with the columns of ``changes`` set where the key matches; a null sets null, unknown keys are ignored.

    ``changes`` must be unique by key. Columns that it lacks are untouched; columns it has beyond those
    stored are ignored.
    """
    names = [c for c in changes.columns if c != key and c in stored.columns]
    new = changes.select(F.col(key).alias("__k"), F.struct(*names).alias("__new"))
    j = stored.join(new, F.col(key) == F.col("__k"), "left")
    return j.select(*[F.when(F.col("__k").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in stored.columns])


def forget(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is not among ``gone``."""
    return stored.join(gone.select(key), key, "left_anti")


def touch_sessions(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """Sessions with ``updated_at`` set to the latest of the appended turns; sessions without one are untouched."""
    last = turns.filter("session_id is not null and created_at is not null").groupBy(F.col("session_id").alias("id")).agg(F.max("created_at").alias("updated_at"))
    return update_by_key(sessions, last, "id")


def append_turns(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Turns with the incoming ones appended, each id once; a stored turn is never changed."""
    fresh = incoming.filter("id is not null").join(stored.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return stored.unionByName(fresh.select(*stored.columns))


def rebuild_check(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): only_old, only_new or changed rows of a rebuilt table, by a null-safe comparison of all columns."""
    cols = [c for c in old.columns if c != key]
    a, b = old.select(F.col(key).alias("ka"), F.struct(*cols).alias("a")), new.select(F.col(key).alias("kb"), F.struct(*cols).alias("b"))
    change = F.when(F.col("ka").isNull(), "only_new").when(F.col("kb").isNull(), "only_old").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, F.col("ka") == F.col("kb"), "full_outer").select(F.coalesce("ka", "kb").alias(key), change.alias("change")).filter("change is not null")


def frozen_subset(ids: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Distinct keys that are not excluded."""
    return ids.select(key).distinct().join(excluded.select(key), key, "left_anti")


def stale_collections(stored: DataFrame, wanted: DataFrame, collection: str, ident: str) -> DataFrame:
    """Collections that hold an id nobody wants any more; each is dropped as a whole."""
    return stored.select(collection, ident).join(wanted.select(collection, ident), [collection, ident], "left_anti").select(collection).distinct()


def filings_of_tickers(filings: DataFrame, companies: DataFrame) -> DataFrame:
    """(ticker, accession): the union of the filings of every CIK that a ticker has had."""
    return companies.select("ticker", "cik").distinct().join(filings.select("cik", "accession").distinct(), "cik").select("ticker", "accession").distinct()


def target_collections(collections: DataFrame, tickers: list[str], years: list[int]) -> DataFrame:
    """Collections ``TICKER_YEAR`` to search: of both, of the tickers, of the years, or all; only those that exist."""
    name = F.col("collection_name")
    ticker, year = F.upper(F.regexp_extract(name, r"^(.*)_[^_]*$", 1)), F.regexp_extract(name, r"_(\d+)$", 1).try_cast("int")
    keep = F.lit(True)
    if tickers:
        keep = keep & ticker.isin([t.upper() for t in tickers])
    if years:
        keep = keep & year.isin(years)
    return collections.select(name).distinct().filter(keep)


def collections_with_filing(filings: DataFrame, as_of: str | None, labels: list[int] | None = None) -> DataFrame:
    """(collection_name, ticker, accession, fiscal_label, filing_date): each eligible collection once, with its filing of the newest period."""
    f = filings.filter("collection_name is not null")
    f = f.filter(F.col("filing_date") <= F.lit(as_of).cast("date")) if as_of else f
    f = f.filter(F.col("fiscal_label").isin(labels)) if labels else f
    newest = F.struct("period_end", "filing_date", "accession", "ticker", "fiscal_label")
    best = f.groupBy("collection_name").agg(F.max(newest).alias("b"))
    return best.select("collection_name", "b.ticker", "b.accession", "b.fiscal_label", "b.filing_date")


def priority_chunks(chunks: DataFrame, document: list[str], section: str) -> DataFrame:
    """Chunks with ``first``: those of sections named by a priority word; all of a document with few chunks or without any such section."""
    name = F.lower(F.coalesce(F.col(section), F.lit("")))
    hit = F.lit(False)
    for word in PRIORITY:
        hit = hit | F.contains(name, F.lit(word))
    sizes = chunks.groupBy(*document).agg(F.count(F.lit(1)).alias("__n"), F.count_if(hit).alias("__p"))
    whole = (F.col("__n") < LEAST_TO_SPLIT) | (F.col("__p") == 0)
    return chunks.join(sizes, document).withColumn("first", whole | hit).drop("__n", "__p")


def current_files(chunks: DataFrame, file: str, doc: str, parses: DataFrame) -> DataFrame:
    """(file, current): whether a chunk file holds chunks of one document, the expected one, and is no older than its parse.

    ``chunks`` hold file, doc and ``written``; ``parses`` hold file, ``expected`` and ``parsed``. A parse
    without chunks is not current.
    """
    held = chunks.groupBy(file).agg(F.min(doc).alias("__lo"), F.max(doc).alias("__hi"), F.count_if(F.col(doc).isNull()).alias("__null"), F.min("written").alias("__written"))
    j = parses.join(held, file, "left")
    ok = (F.col("__lo") == F.col("expected")) & (F.col("__hi") == F.col("expected")) & (F.col("__null") == 0) & (F.col("parsed").isNull() | (F.col("__written") >= F.col("parsed")))
    return j.select(file, F.coalesce(ok, F.lit(False)).alias("current"))


def primary_documents(files: DataFrame) -> DataFrame:
    """(accession, name): the named primary document above a least size, else the largest other page, else null for extraction.

    ``files`` hold accession, name and size in bytes; index pages never count; of equal sizes the least name.
    """
    low = F.lower("name")
    named = low.isin(*PRIMARY_NAMES)
    page = low.rlike(r"\.html?$") & ~F.contains(low, F.lit("index"))
    good = (F.col("size") > LEAST_DOCUMENT) & (named | page)
    order = F.struct(F.when(named, 0).otherwise(1).alias("a"), F.when(named, 0).otherwise(-F.col("size")).alias("b"), F.col("name"))
    return files.groupBy("accession").agg(F.min(F.when(good, order)).getField("name").alias("name"))


def fingerprint(rows: DataFrame, group: list[str], row: Column) -> DataFrame:
    """(group..., rows, hash): SHA-256 over a group's rows in any order.

    Row hashes are first combined within 65,536 buckets of their leading digits, then the buckets' hashes,
    so no group is gathered at once, however many rows it has.
    """
    hashed = rows.select(*group, F.sha2(row, 256).alias("__r")).withColumn("__b", F.substring("__r", 1, 4))
    join = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\u001e"), 256)
    parts = hashed.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("rows"), join("__r").alias("__h"))
    return parts.groupBy(*group).agg(F.sum("rows").alias("rows"), join(F.concat("__b", "__h")).alias("hash"))


def run_totals(events: DataFrame, run: str, at: str, tokens: str) -> DataFrame:
    """(run, n, tokens, seconds, rate): totals of indexing runs and rows a second; null for runs of a single moment."""
    g = events.groupBy(run).agg(F.count(F.lit(1)).alias("n"), F.sum(tokens).alias("tokens"), (F.max(at) - F.min(at)).alias("seconds"))
    return g.withColumn("rate", F.round(F.try_divide(F.col("n").cast("double"), F.col("seconds")), 6))


def smallest_first(sizes: DataFrame, name: str) -> DataFrame:
    """Rows (name, n) ordered by size and then name."""
    return sizes.orderBy("n", name)


def seeded_sample(rows: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of the least seeded hashes: the same rows however they are spread; each task keeps its own least."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))
    return rows.orderBy(h, ident).limit(n)


def best_hit(scored: DataFrame, group: list[str], score: str, position: str) -> DataFrame:
    """The row of the greatest score of each group, the first by ``position`` among equals; nulls never win."""
    rest = [c for c in scored.columns if c not in group]
    order = F.struct(F.col(score), -F.col(position))
    best = scored.filter(F.col(score).isNotNull()).groupBy(*group).agg(F.max_by(F.struct(*rest), order).alias("__b"))
    return best.select(*group, "__b.*")


def zero_filled(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, n): counts of the given values, 0 where none occurs."""
    spark = rows.sparkSession
    dims = spark.createDataFrame([(v,) for v in values], f"{column} string")
    return dims.join(rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a report as csv, json or parquet; the committer moves it into place when it is whole."""
    df.write.mode("overwrite").format(kind).option("header", "true").save(path)
