"""Readers and writers of the engine's other formats."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut

#: Letters of the runs by which names and titles that contain one another are found.
_RUN = 3
_FACT = "MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<accn: STRING, start: STRING, end: STRING, val: STRING>>>>>"


def parse_json_lines(lines: DataFrame, line: str, at: str, schema: str, ident: str | None = None) -> DataFrame:
    """Rows of JSON lines: blank, comment (``//``) and malformed lines are skipped; the last row of an id, by ``at``, wins."""
    kept = lines.select(F.col(line).alias("value"), F.col(at).alias("__n")).filter((F.trim("value") != "") & ~F.ltrim("value").startswith("//"))
    rows = kept.select("__n", F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNotNull().alias("ok")).filter("ok and r is not null")
    if ident is None:
        return rows.select("r.*")
    last = rows.groupBy(F.col("r").getField(ident).alias("__id")).agg(F.max_by("r", "__n").alias("r"))
    return last.select("r.*")


def json_lines(spark: SparkSession, path: str, schema: str, ident: str | None = None) -> DataFrame:
    """Rows of a JSONL file, see ``parse_json_lines``; lines are numbered by file and place."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("__at"))
    return parse_json_lines(lines, "value", "__at", schema, ident)


def cached_documents(spark: SparkSession, path: str, least_bytes: int = 1) -> DataFrame:
    """(name, content) of cached JSON files below a folder: what a fetcher without network answers from.

    Empty files, pages that refuse the request and texts that are no JSON are left out: a poisoned cache is none.
    """
    from ..functions.textops import is_error_page

    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("content"))
    return text.filter((F.length("content") >= least_bytes) & ~is_error_page(F.col("content")) & F.try_parse_json("content").isNotNull())


def companyfacts(documents: DataFrame, content: str, order: str | None = None) -> DataFrame:
    """(accession, concept, start, end, unit, value) of nested fact documents.

    Rows without accession, end or value are skipped; a missing start is ''; the last row of a key wins,
    by ``order`` of the documents, where it is given, and then by place.
    """
    parsed = documents.select((F.col(order) if order else F.lit(0)).alias("__d"), F.from_json(F.col(content), f"facts MAP<STRING, {_FACT}>").getField("facts").alias("t"))
    flat = parsed.select("__d", F.explode("t").alias("taxonomy", "concepts")).select("__d", "taxonomy", F.explode("concepts").alias("concept", "c")).select("__d", "taxonomy", "concept", F.explode("c.units").alias("unit", "rows")).select("__d", "taxonomy", "concept", "unit", F.posexplode("rows").alias("at", "r"))
    good = flat.filter("r.accn is not null and r.end is not null and r.val is not null").select(F.col("r.accn").alias("accession"), F.concat_ws(":", "taxonomy", "concept").alias("concept"), F.coalesce("r.start", F.lit("")).alias("start"), F.col("r.end").alias("end"), "unit", F.col("r.val").try_cast("decimal(38,10)").alias("value"), F.struct("__d", "at").alias("at"))
    return good.groupBy("accession", "concept", "start", "end", "unit").agg(F.max_by("value", "at").alias("value"))


def oracle_units(unit: Column) -> Column:
    """One spelling of a unit: a rate per share is written with a slash, however the oracle names it."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(unit, F.lit("")), r"(?i)^USD-per-shares$", "USD/shares"), r"^iso4217:|^xbrli:", "")


def join_oracle(ours: DataFrame, oracle: DataFrame) -> DataFrame:
    """Facts (accession, concept, start, end, unit, value) with the oracle's ``theirs`` on all five keys; null where it states none.

    Units meet under any of their names; a missing start is the empty string; of several oracle values of
    a key the least counts.
    """
    keys = ["accession", "concept", "start", "end", "__u"]
    o = oracle.withColumn("__u", oracle_units(F.col("unit"))).withColumn("start", F.coalesce("start", F.lit(""))).groupBy(*keys).agg(F.min("value").alias("theirs"))
    return ours.withColumn("__u", oracle_units(F.col("unit"))).withColumn("start", F.coalesce("start", F.lit(""))).join(o, keys, "left").drop("__u")


def annual_parts(submission: Column) -> Column:
    """Documents of a full submission whose type is an annual report or its exhibit 13, joined by marker comments."""
    parts = F.split(submission, r"(?i)<DOCUMENT>")
    kind = lambda p: F.upper(F.trim(F.regexp_extract(p, r"(?i)<TYPE>([^\s<]+)", 1)))
    kept = F.filter(parts, lambda p: kind(p).startswith("10-K") | kind(p).startswith("EX-13"))
    body = F.transform(kept, lambda p: F.trim(F.regexp_extract(p, r"(?is)<TEXT>(.*?)(?:</TEXT>|$)", 1)))
    return F.array_join(body, "\n<!-- next document -->\n")


def companies(registry: DataFrame) -> DataFrame:
    """(ticker, title, cik) with the cik padded to ten digits."""
    return registry.select(F.upper("ticker").alias("ticker"), "title", F.lpad(F.col("cik_str").cast("string"), 10, "0").alias("cik"))


def find_company(registry: DataFrame, names: DataFrame) -> DataFrame:
    """(name, ticker): exact ticker, else a title that contains the name or is contained in it, shortest title first.

    Tickers are met by an equi-join. Containment is found by equal runs of characters: every title and
    name is cut into runs of ``_RUN``, the shorter side's first run must occur in the longer one, and only
    such pairs are compared, so no side is sent around. Names of fewer letters match a ticker or an
    equal title only. Null names are left out.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    r = registry.select("ticker", "title", plain(F.col("title")).alias("t")).filter("ticker is not null")
    n = names.select("name").filter("name is not null").distinct().withColumn("k", plain(F.col("name")))
    exact = n.join(r.select(F.col("ticker").alias("__t"), "ticker", "title"), F.upper("name") == F.col("__t")).select("name", "ticker", F.lit(0).alias("rank"), F.length("title").alias("length"))
    runs = lambda df, c: df.filter(F.length(c) >= _RUN).withColumn("run", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (_RUN - 1)), lambda i: F.substring(F.col(c), i, F.lit(_RUN))))))
    head = lambda df, c: df.filter(F.length(c) >= _RUN).withColumn("run", F.substring(c, 1, _RUN))
    inside = head(n, "k").join(runs(r, "t"), "run").filter(F.contains("t", F.col("k")))
    around = runs(n, "k").join(head(r, "t"), "run").filter(F.contains("k", F.col("t")))
    same = n.join(r.withColumnRenamed("t", "k"), "k")
    close = inside.select("name", "ticker", "title").unionByName(around.select("name", "ticker", "title")).unionByName(same.select("name", "ticker", "title"))
    met = exact.unionByName(close.select("name", "ticker", F.lit(1).alias("rank"), F.length("title").alias("length")))
    best = met.groupBy("name").agg(F.min(F.struct("rank", "length", "ticker")).alias("b"))
    return n.select("name").join(best, "name", "left").select("name", F.col("b.ticker").alias("ticker"))


def merge_collections(stored: DataFrame, incoming: DataFrame, ident: str, collection: str, order: list[str]) -> DataFrame:
    """Stored chunks with the incoming ones in the place of their namesakes; of several incoming ones the greatest by ``order`` counts.

    The key is (collection, ident). Nulls in the key are a value of their own; equal rows by ``order`` are
    told apart by their whole content. Both sides need the same columns.
    """
    rest = [c for c in incoming.columns if c not in (ident, collection)]
    last = incoming.groupBy(collection, ident).agg(F.max(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))).alias("__m")).select(collection, ident, "__m.row.*")
    a, b = stored.alias("a"), last.select(collection, ident).alias("b")
    kept = a.join(b, F.col(f"a.{collection}").eqNullSafe(F.col(f"b.{collection}")) & F.col(f"a.{ident}").eqNullSafe(F.col(f"b.{ident}")), "left_anti")
    return kept.unionByName(last.select(*stored.columns))


def write_collections(chunks: DataFrame, path: str, ident: str, collection: str, order: list[str] | None = None) -> None:
    """Upsert chunks into a table partitioned by collection: stored chunks that aren't written again stay.

    Of several incoming chunks of one id the greatest by ``order`` (default: whole content) counts. Only
    the collections that chunks come for are read and rewritten; the merged rows are written to the
    shared checkpoint folder first, since a table cannot be overwritten while it is read.
    """
    spark = chunks.sparkSession
    incoming = cut(chunks)
    try:
        stored = spark.read.parquet(path)
    except AnalysisException:
        stored = None
    if stored is not None:
        touched = incoming.select(F.col(collection).cast(dict(stored.dtypes)[collection])).distinct()
        stored = stored.join(touched, collection, "left_semi").withColumn(collection, F.col(collection).cast(dict(incoming.dtypes)[collection])).select(*incoming.columns)
    else:
        stored = incoming.limit(0)
    merged = cut(merge_collections(stored, incoming, ident, collection, order or []))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(collection).parquet(path)


def missing_rows(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Source rows not yet stored: what a resumed copy still has to write."""
    return source.join(target.select(*key), key, "left_anti")


def copy_collections(source: DataFrame, target: DataFrame, ident: str, collection: str) -> DataFrame:
    """Rows that a copy still has to write: collections of equal counts are skipped, of others only what is missing."""
    n = source.groupBy(collection).agg(F.count(F.lit(1)).alias("__n"))
    m = target.groupBy(collection).agg(F.count(F.lit(1)).alias("__m"))
    open_ = n.join(m, collection, "left").filter("__m is null or __n <> __m").select(collection)
    return missing_rows(source.join(open_, collection, "left_semi"), target, [collection, ident])
