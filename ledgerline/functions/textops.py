"""Text operators of the answering pipeline: tables, markers, tags, sections, chunks and packed context."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .phrases import phrase

# Items of an annual report with the word that their heading goes on with, statements by what
# they are statements of, and headings that are told by their whole title.
ITEMS = (
    ("1a", "risk factor", "item_1a_risk_factors"), ("1b", "unresolved", "item_1b_staff"), ("1c", "cyber", "item_1c_cyber"), ("1", "business", "item_1_business"), ("2", "propert", "item_2_properties"), ("3", "legal", "item_3_legal"), ("4", "mine", "item_4_mine"), ("5", "market", "item_5_market"),
    ("6", "selected", "item_6_selected"), ("7a", "quantitative", "item_7a_market_risk"), ("7", "management", "item_7_mda"), ("8", "financial", "item_8_financials"), ("9a", "controls", "item_9a_controls"), ("9b", "other", "item_9b_other"), ("9", "change", "item_9_accountants"), ("15", "exhibit", "item_15_exhibits"),
)
GOVERNANCE = ((10, 14), "item_governance")
STATEMENTS = {
    "fs_income_stmt": ("statement/s of operations|income|earnings", "income|earnings statement/s"), "fs_balance_sheet": ("balance sheet/s", "statement/s of financial condition|position", "statement/s of condition"), "fs_cash_flow": ("statement/s of cash flow/s",),
    "fs_equity": ("statement/s of stockholders|shareholders", "statement/s of changes in equity"),
}
TITLES = {"risk factors": "item_1a_risk_factors", "financial review": "item_7_mda", "controls and procedures": "item_9a_controls"}
BEGINNINGS = {"quantitative and qualitative": "item_7a_market_risk"}
INSIDE = (("note/s to financial statement/s", "fs_notes"), ("note/s to consolidated financial statement/s", "fs_notes"), ("financial statements and supplementary", "item_8_financials"))


def _section_patterns() -> tuple[tuple[str, str], ...]:
    """(pattern, section) of headings in order of precedence: items by number and word, statements, notes and titles."""
    gap = r"[\.\s:—–-]*"
    out = [(rf"item\s*{n}{gap}{phrase(word)}", name) for n, word, name in ITEMS if n != "15"]
    (low, high), name = GOVERNANCE
    out.append((rf"item\s*(?:{'|'.join(str(i) for i in range(low, high + 1))})[\.\s:]", name))
    out += [(rf"item\s*{n}{gap}{phrase(word)}", name) for n, word, name in ITEMS if n == "15"]
    out += [(rf"consolidated\s+{phrase(kind)}", name) for name, kinds in STATEMENTS.items() for kind in kinds]
    out += [(phrase(p), name) for p, name in INSIDE[:2]]
    out += [(rf"^{phrase(p)}$", name) for p, name in list(TITLES.items())[:1]]
    out.append((r"management.s\s+discussion\s+and\s+analysis", "item_7_mda"))
    out += [(rf"^{phrase(p)}$", name) for p, name in list(TITLES.items())[1:]]
    out += [(rf"^{phrase(p)}", name) for p, name in BEGINNINGS.items()]
    return (*out, *[(phrase(p), name) for p, name in INSIDE[2:]])


SECTION_PATTERNS = _section_patterns()
HEADING_LENGTH = 120


def estimate_tokens(text: Column) -> Column:
    """Length over 4 (2 where bars are frequent), rounded down, plus one; 0 for an empty text."""
    n = F.length(text)
    bars = n - F.length(F.replace(text, F.lit("|"), F.lit("")))
    ratio = F.when(F.try_divide(bars, n) >= 0.02, 2.0).otherwise(4.0)
    return F.when(n == 0, 0).otherwise(F.floor(n / ratio).cast("int") + 1)


def compress_rows(text: Column) -> Column:
    """Repeated cells of table rows once, empty tails cut, and total rows right behind the two head lines."""
    one = lambda x: F.when(F.contains(x, F.lit("|")) & ~F.contains(x, F.lit("---")), F.regexp_replace(F.regexp_replace(F.rtrim(x), r"(\|[^|]+)\1+", "$1"), r"(\|\s*)+$", "|")).otherwise(x)
    lines = F.transform(F.split(text, "\n"), one)
    total = lambda x: F.ltrim(x).rlike(r"(?i)^\|\s*total\b")
    rest = F.slice(lines, 3, F.greatest(F.size(lines) - 2, F.lit(0)))
    floated = F.concat(F.slice(lines, 1, 2), F.filter(rest, total), F.filter(rest, lambda x: ~total(x)))
    return F.array_join(F.when(F.size(lines) > 3, floated).otherwise(lines), "\n")


def normalize_markers(text: Column) -> Column:
    """Citation markers of all bracket styles and digit widths as ``[N]``, combined ones taken apart."""
    t = F.translate(text, "０１２３４５６７８９", "0123456789")
    t = F.regexp_replace(t, r"[【［〚〖〈]\s*(\d+(?:\s*[,;]\s*\d+)*)\s*[】］〛〗〉]", "[$1]")
    t = F.regexp_replace(t, r"\[\s*(\d+)\s*\]", "[$1]")
    t = F.regexp_replace(t, r"(?<=\[[\d\s,;]{0,200})(\d+)\s*[,;]\s*(?=[\d\s,;]*\])", "$1] [")
    return F.regexp_replace(t, r"(\d)\s+\]", "$1]")


def strip_tags(html: Column) -> Column:
    """Text without inline-XBRL tags (their content stays)."""
    return F.regexp_replace(html, r"(?i)</?(?:ix|xbrli|xbrldi):[^>]*>", "")


def is_error_page(content: Column) -> Column:
    """True for a refusal page of the filing archive: its markers stand in the first 4,096 characters."""
    head = F.lower(F.substring(content, 1, 4096))
    return head.rlike(r"undeclared automated tool|request rate threshold exceeded|your request originates from")


def section_of(line: Column) -> Column:
    """Section that a line heads, null if it is no heading."""
    t = F.trim(F.lower(line))
    out = F.lit(None).cast("string")
    for pattern, name in reversed(SECTION_PATTERNS):
        out = F.when(t.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when((F.length(t) > 0) & (F.length(t) <= HEADING_LENGTH), out)


def slices(headings: DataFrame, doc: str, line_no: str, lengths: DataFrame) -> DataFrame:
    """Headings with ``until`` (the next heading's line, or the document's ``lines``) and ``part``.

    Several slices of one section are numbered by falling length; the longest keeps the plain name.
    """
    h = headings.join(lengths, doc).withColumn("until", F.coalesce(F.lead(line_no).over(Window.partitionBy(doc).orderBy(line_no)), F.col("lines")))
    k = F.row_number().over(Window.partitionBy(doc, "section").orderBy((F.col("until") - F.col(line_no)).desc(), line_no))
    return h.withColumn("__k", k).withColumn("part", F.when(F.col("__k") == 1, F.col("section")).otherwise(F.concat_ws("__", "section", F.col("__k").cast("string")))).drop("__k")


def cache_key(*names: str) -> Column:
    """SHA-256 over the given columns; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(n), F.lit("")) for n in names]), 256)


def embedded_json(text: Column) -> Column:
    """JSON object in a reply: fenced, or from the first brace to the last; null if it doesn't parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    found = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))
    return F.when(F.try_parse_json(found).isNotNull() & (found != ""), found)


def split_text(text: str, max_tokens: int, overlap: int) -> list[str]:
    """Sentences filled into chunks of at most ``max_tokens`` words; the last ``overlap`` ones begin the next.

    A sentence longer than a chunk stands alone.
    """
    import re

    out: list[str] = []
    held: list[str] = []
    used = 0
    for s in re.split(r"(?<=[.!?])\s+", text.strip()):
        n = len(s.split())
        if not n:
            continue
        if n > max_tokens:
            if held:
                out.append(" ".join(held))
            out.append(s)
            held, used = [], 0
            continue
        if held and used + n > max_tokens:
            out.append(" ".join(held))
            held = held[-overlap:] if overlap else []
            used = sum(len(x.split()) for x in held)
            while held and used + n > max_tokens:
                used -= len(held.pop(0).split())
        held.append(s)
        used += n
    if held:
        out.append(" ".join(held))
    return out


def split_table(text: str, max_tokens: int) -> list[str]:
    """A Markdown table in pieces that each repeat head, separator and the leading rows without figures."""
    import re

    rows = text.strip().split("\n")
    size = lambda x: len(x.split())
    if size(text) <= max_tokens or len(rows) < 4:
        return [text]
    lead = 2
    while lead < min(len(rows), 10) and not re.search(r"\|\s*\$?\s*(?:\d{5,}|\d{1,3}(?:,\d{3}){2,})\s*\|", rows[lead]):
        lead += 1
    head, body = rows[:lead], rows[lead:]
    room = max(1, max_tokens - size(" ".join(head)))
    per = max(1, room // max(1, size(" ".join(body[:10])) // max(1, min(10, len(body)))))
    return ["\n".join(head + body[i : i + per]) for i in range(0, len(body), per)] or [text]


def chunks(documents: DataFrame, ident: str, text: str, max_tokens: int = 1000, overlap: int = 2) -> DataFrame:
    """(ident, position, kind, chunk): paragraphs and tables of every text cut into chunks. Null texts give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, at, kind, out = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = 0
                blocks: list[tuple[str, list[str]]] = []
                for line in t.split("\n"):
                    k = "table" if line.startswith("|") else "text"
                    if not line.strip():
                        blocks.append(("", []))
                    elif blocks and blocks[-1][0] == k:
                        blocks[-1][1].append(line)
                    else:
                        blocks.append((k, [line]))
                for k, lines in blocks:
                    for piece in (split_table("\n".join(lines), max_tokens) if k == "table" else split_text(" ".join(lines), max_tokens, overlap) if k else []):
                        who.append(i)
                        at.append(n)
                        kind.append(k)
                        out.append(piece)
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array(who, b.schema.types[0]), pa.array(at, pa.int32()), pa.array(kind, pa.string()), pa.array(out, pa.string())], names=[ident, "position", "kind", "chunk"])

    t = dict(documents.dtypes)[ident]
    return documents.select(ident, text).filter(F.col(ident).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, f"{ident} {t}, position int, kind string, chunk string")


def pack_context(passages: DataFrame, group: list[str], ident: str, text: str, budget: int) -> DataFrame:
    """(group..., ident, position, tokens, taken): passages packed in order until the budget is first exceeded.

    The first passage of a group is cut to the budget rather than dropped; everything behind the first
    overflow stays out.
    """
    w = Window.partitionBy(*group).orderBy(ident)
    sized = passages.select(*group, ident, estimate_tokens(F.col(text)).alias("tokens"))
    run = sized.withColumn("position", F.row_number().over(w)).withColumn("__sum", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # sums only grow, so the first overflow ends the group
    kept = run.filter((F.col("__sum") <= budget) | (F.col("position") == 1))
    return kept.select(*group, ident, "position", "tokens", F.least("tokens", F.lit(budget)).alias("taken"))
