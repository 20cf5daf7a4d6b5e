"""Inline-XBRL documents as DataFrames of contexts, units and facts.

The scan is a small event-driven reader on the standard library's HTML parser; transforms, scaling,
joins and filters are column expressions on its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numerals import tagged_number
from ..functions.transforms import KNOWN, tagged_text

FIELDS = ("kind", "name", "context_id", "unit_ref", "format", "scale", "sign", "decimals", "text", "nil", "hidden", "element_id", "entity", "instant", "start", "end")
SCHEMA = "doc string, seq int, " + ", ".join(f"{f} string" for f in FIELDS) + ", dimensions array<struct<axis:string,member:string>>, measures array<string>, denominators array<string>"
_ARROW = pa.schema([("doc", pa.string()), ("seq", pa.int32()), *[(f, pa.string()) for f in FIELDS], ("dimensions", pa.list_(pa.struct([("axis", pa.string()), ("member", pa.string())]))), ("measures", pa.list_(pa.string())), ("denominators", pa.list_(pa.string()))])
_TAGGED = {"ix:nonfraction": "number", "ix:nonnumeric": "text"}


class _Reader(HTMLParser):
    """Collects one row per context, unit and tagged fact in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.facts: list[dict] = []  # open tagged facts, innermost last
        self.item: dict | None = None  # open context or unit
        self.leaf = ""
        self.axis = ""
        self.below = False
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        local = tag.rsplit(":", 1)[-1]
        if tag == "ix:hidden":
            self.hidden += 1
        elif tag in _TAGGED:
            self.facts.append({"kind": _TAGGED[tag], "name": a.get("name", ""), "context_id": a.get("contextref", ""), "unit_ref": a.get("unitref"), "format": a.get("format"), "scale": a.get("scale"), "sign": a.get("sign"), "decimals": a.get("decimals"), "element_id": a.get("id"), "nil": "true" if a.get("xsi:nil", "").lower() in ("true", "1") else "false", "hidden": "true" if self.hidden else "false", "text": ""})
        elif local == "context":
            self.item = {"kind": "context", "name": a.get("id", ""), "dimensions": []}
        elif local == "unit":
            self.item = {"kind": "unit", "name": a.get("id", ""), "measures": [], "denominators": []}
        elif local == "unitdenominator":
            self.below = True
        elif local in ("explicitmember", "typedmember"):
            self.axis, self.leaf = a.get("dimension", ""), "member"
        elif local in ("instant", "startdate", "enddate", "identifier", "measure"):
            self.leaf = local
        elif self.facts and tag in ("br", "p", "div", "tr") and self.facts[-1]["text"]:
            self.facts[-1]["text"] += " "

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        local = tag.rsplit(":", 1)[-1]
        if tag == "ix:hidden":
            self.hidden = max(0, self.hidden - 1)
        elif tag in _TAGGED and self.facts:
            done = self.facts.pop()
            self.rows.append(done)
            if self.facts:
                self.facts[-1]["text"] += done["text"]
        elif local in ("context", "unit") and self.item:
            self.rows.append(self.item)
            self.item = None
        elif local == "unitdenominator":
            self.below = False
        elif local in ("instant", "startdate", "enddate", "identifier", "measure", "explicitmember", "typedmember"):
            self.leaf = ""

    def handle_data(self, data: str) -> None:
        if self.item is not None and self.leaf:
            t = data.strip()
            if not t:
                return
            if self.leaf == "measure":
                self.item["denominators" if self.below else "measures"].append(t.rsplit(":", 1)[-1])
            elif self.leaf == "member":
                self.item["dimensions"].append({"axis": self.axis, "member": t})
            else:
                self.item[{"identifier": "entity", "startdate": "start", "enddate": "end"}.get(self.leaf, self.leaf)] = t
        elif self.facts:
            self.facts[-1]["text"] += data


def decoded(content: bytes) -> str:
    """Text of a document: the declared charset, else UTF-8 if it decodes, else Windows-1252."""
    head = content[:2048].lower()
    at = head.find(b"charset=")
    named = head[at + 8 : at + 40].strip(b"\"' ").split(b'"')[0].split(b"'")[0].split(b">")[0].split(b";")[0].strip().decode("ascii", "ignore") if at >= 0 else ""
    for charset in (named, "utf-8", "cp1252"):
        try:
            if charset:
                return content.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("cp1252", "replace")


def scan_text(text: str) -> list[dict]:
    reader = _Reader()
    reader.feed(text)
    reader.close()
    reader.rows += reader.facts  # facts left open by a cut-off document
    return reader.rows


def scan(documents: DataFrame, doc: str, content: str) -> DataFrame:
    """Rows of ``SCHEMA`` for every document (text or binary); null contents give none."""
    return _scanned(documents, doc, content, lambda rows: [{"seq": i} | r for i, r in enumerate(rows)])


def _scanned(documents: DataFrame, doc: str, content: str, told: Callable[[list[dict]], list[dict]]) -> DataFrame:
    binary = dict(documents.dtypes)[content] == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows += [{"doc": d} | r for r in told(scan_text(decoded(c) if binary else c))]
            cols = [pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW]
            yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)

    return documents.select(F.col(doc).cast("string").alias("doc"), F.col(content).alias("c")).filter("c is not null").mapInArrow(run, SCHEMA)


def _resolved(rows: list[dict]) -> list[dict]:
    """The tagged facts of one document, each with its context and unit; the first definition of an id wins."""
    contexts: dict[str, dict] = {}
    units: dict[str, dict] = {}
    for r in rows:
        if r["kind"] in ("context", "unit"):
            (contexts if r["kind"] == "context" else units).setdefault(r["name"], r)
    out = []
    for i, r in enumerate(rows):
        if r["kind"] in ("number", "text"):
            of, unit = contexts.get(r["context_id"], {}), units.get(r["unit_ref"], {})
            out.append({"seq": i} | r | {k: of.get(k) for k in ("entity", "instant", "start", "end", "dimensions")} | {k: unit.get(k) for k in ("measures", "denominators")})
    return out


def scan_facts(documents: DataFrame, doc: str, content: str) -> DataFrame:
    """Facts of every document that is a filing of its own, as of ``facts``: joined in the task that reads it, so nothing is shuffled or kept."""
    return _values(_scanned(documents, doc, content, _resolved).withColumn("unit", _label()), "doc")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Scan of every file under a path; ``doc`` is the file's name."""
    files = spark.read.format("binaryFile").load(path)
    return scan(files.select(F.element_at(F.split("path", "/"), -1).alias("doc"), "content"), "doc", "content")


def facts(scanned: DataFrame, filing: str = "doc") -> DataFrame:
    """Facts joined with their contexts and units after pooling all documents of a filing.

    The first definition of an id wins; an unresolved unit keeps its reference; nil facts have a null value.
    """
    first = Window.partitionBy(filing, "kind", "name").orderBy("doc", "seq")
    defs = scanned.filter("kind in ('context', 'unit')").withColumn("__n", F.row_number().over(first)).filter("__n = 1")
    contexts = defs.filter("kind = 'context'").select(filing, F.col("name").alias("context_id"), "entity", "instant", "start", "end", "dimensions")
    units = defs.filter("kind = 'unit'").select(filing, F.col("name").alias("unit_ref"), _label().alias("unit"))
    f = scanned.filter("kind in ('number', 'text')").drop("entity", "instant", "start", "end", "dimensions")
    return _values(f.join(contexts, [filing, "context_id"], "left").join(units, [filing, "unit_ref"], "left"), filing)


def _label() -> Column:
    """Name of a unit; null where there is none."""
    below = F.when(F.size("denominators") > 0, F.concat(F.lit("/"), F.array_join("denominators", "*"))).otherwise("")
    return F.when(F.size("measures") == 0, "?").otherwise(F.concat(F.array_join("measures", "*"), below))


def _values(joined: DataFrame, filing: str) -> DataFrame:
    joined = joined.withColumns({"instant": F.to_date("instant"), "start_date": F.to_date("start"), "end": F.to_date("end")})
    number = (F.col("kind") == "number") & (F.col("nil") == "false")
    return joined.select(
        filing, "doc", "seq", F.col("name").alias("concept"), "context_id", F.coalesce("unit", "unit_ref").alias("unit"), "decimals", F.col("scale").alias("scale_raw"), F.col("sign").alias("sign_raw"), "hidden", "element_id",
        F.when(number, tagged_number(F.when(number, F.col("format")), F.when(number, F.col("text")), F.col("scale"), F.col("sign"))).alias("value"), F.when((F.col("kind") == "text") & (F.col("nil") == "false"), tagged_text(F.col("format"), F.col("text")).getField("value")).alias("value_text"),
        F.when(F.col("instant").isNotNull(), "instant").otherwise("duration").alias("period_type"), "start_date", F.coalesce("instant", "end").alias("end_date"), "dimensions",
    )


def format_survey(scanned: DataFrame) -> DataFrame:
    """(format, kind, n) of all tagged facts."""
    return scanned.filter("kind in ('number', 'text')").groupBy("format", "kind").agg(F.count(F.lit(1)).alias("n"))


def untransformed(scanned: DataFrame) -> DataFrame:
    """(format, n): formats of tagged texts for which there is no transform."""
    name = F.lower(F.regexp_replace(F.col("format"), r"^.*:", ""))
    return scanned.filter((F.col("kind") == "text") & F.col("format").isNotNull() & ~name.isin(*KNOWN)).groupBy("format").agg(F.count(F.lit(1)).alias("n"))
