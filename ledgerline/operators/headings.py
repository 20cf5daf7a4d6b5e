"""Sections of a filing out of its lines: heading candidates, their scores, statements, and the chosen boundaries.

A document is read line by line in one pass; what is weighed and chosen stays within it, so filings are
handled where they are read, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phrases import any_of
from ..functions.textops import HEADING_LENGTH, ITEMS, SECTION_PATTERNS
from ..sources.tables import filing_lines
from .sections import heaviest

_PATTERNS = [(re.compile(p), name) for p, name in SECTION_PATTERNS]
#: Rank of sections in a report: items by number and letter.
ORDER = {name: i for i, name in enumerate([*[s for _, _, s in sorted(ITEMS[:-1], key=lambda x: (int(re.match(r"\d+", x[0])[0]), x[0]))], "item_governance", "item_15_exhibits"])}
# Lengths of headings and of prose, the lines looked ahead, the zone of statements and the weights of a candidate.
JOINED_LENGTH, NEXT_LENGTH, LINE_LENGTH, STATEMENT_LENGTH, PROSE_LENGTH = 35, 100, 250, 100, 200
PROSE_LINES, JOIN_LINES, RECOVERED_LINES = 15, 4, 1000
ZONE = (0.15, 0.97)
SENTINEL_SCORE, ITEM_SCORE, SHORT_SCORE, PAGE_SCORE, RUN_SCORE, PROSE_WEIGHT = 2, 4, 3, -5, -4, 20
SENTINEL = "§§ "
_POINTS_AWAY = re.compile(any_of("refer/s/red to, see, described|discussed|contained in, set forth in, elsewhere in, incorporated by reference, on page/s", r"\bpages?\s+\d"))
_POINTER = re.compile(r"(?i)incorporated\s+(?:herein\s+)?by\s+reference|^\s*refer\s+to\b|\bon\s+pages?\s+\d|\bpages?\s+\d+\s*[–—-]\s*\d")
_PART = re.compile(r"(?i)^\s*part\s+[ivx]+\s*[,.:;—–-]*\s*")
_PAGE = re.compile(r"[\s.·…]\d{1,3}\s*$")
_ITEM = re.compile(r"(?i)item\s*\d")
_TABLE = re.compile(r"^<<<TABLE_\d+>>>$")


def section_of_text(text: str) -> str | None:
    """Section of the first pattern that a text holds."""
    low = text.lower().strip()
    return next((name for p, name in _PATTERNS if p.search(low)), None)


class Lines:
    """Lines of a document with the section that each could head; every line is matched once."""

    def __init__(self, lines: list[str]) -> None:
        self.lines = [x.strip() for x in lines]
        self.found: list[tuple[str, str, int] | None] = [self._match(i) if x and len(x) <= LINE_LENGTH else None for i, x in enumerate(self.lines)]

    def _match(self, i: int) -> tuple[str, str, int] | None:
        """(section, matched text, last line): a line, or a short "Item n" line joined with the next one, with or without a blank."""
        line = self.lines[i]
        if line.startswith(SENTINEL):
            return None
        name = section_of_text(line)
        if name:
            return name, line, i
        if len(line) < JOINED_LENGTH and _ITEM.match(line):
            for j in range(i + 1, min(i + 1 + JOIN_LINES, len(self.lines))):
                if self.lines[j]:
                    if len(self.lines[j]) < NEXT_LENGTH:
                        for text in (f"{line} {self.lines[j]}", line + self.lines[j]):
                            name = section_of_text(text)
                            if name:
                                return name, text, j
                    break
        return None

    def behind(self, last: int) -> tuple[bool, bool]:
        """(a heading follows at once, prose follows before the next heading)."""
        seen = 0
        at_once = False
        for j in range(last + 1, len(self.lines)):
            line = self.lines[j]
            if not line:
                continue
            if self.found[j] is not None:
                return at_once or seen == 0, False
            if len(line) >= PROSE_LENGTH and not _TABLE.match(line) and not line.startswith(SENTINEL) and not _POINTER.search(line):
                return at_once, True
            seen += 1
            if seen >= PROSE_LINES:
                break
        return at_once, False


def _anchored(text: str) -> tuple[bool, set[str]]:
    """(names an item, sections whose pattern the text begins with), a leading part aside."""
    rest = _PART.sub("", text.lower().strip())
    return _ITEM.match(rest) is not None, {name for p, name in _PATTERNS if p.match(rest)}


def candidates(lines: list[str]) -> list[tuple[int, str, int, bool]]:
    """(line, section, score, has prose) of every possible item heading; references and mid-sentence mentions are none."""
    doc = Lines(lines)
    out = []
    for i in range(int(len(lines) * ZONE[1]) + 1):
        if i >= len(lines):
            break
        line = doc.lines[i]
        if line.startswith(SENTINEL):
            name, last, score, item = section_of_text(line[len(SENTINEL):]), i, SENTINEL_SCORE, True
        elif doc.found[i] is not None:
            name, text, last = doc.found[i]
            item, begins = _anchored(text)
            if _POINTS_AWAY.search(text) or name not in begins:
                continue
            score = 0
        else:
            continue
        if name is None or name.startswith("fs_"):
            continue
        run, prose = doc.behind(last)
        score += ITEM_SCORE * item + SHORT_SCORE * (len(line) <= HEADING_LENGTH) + PAGE_SCORE * (_PAGE.search(line) is not None) + RUN_SCORE * run
        out.append((i, name, score, prose))
    return out


def statements(lines: list[str]) -> dict[str, int]:
    """Line of each financial statement: one recovered from a table's head wins, else the last heading-like line of the zone, else the last line that names it."""
    n = len(lines)
    marked, short, any_ = {}, {}, {}
    for i, raw in enumerate(lines):
        line = raw.strip()
        if line.startswith(SENTINEL):
            name = section_of_text(line[len(SENTINEL):])
            if name and name.startswith("fs_"):
                marked.setdefault(name, i)
        elif line and n * ZONE[0] <= i <= n * ZONE[1]:
            name = section_of_text(line) if len(line) <= 4 * STATEMENT_LENGTH else None
            if name and name.startswith("fs_"):
                any_[name] = i
                if len(line) <= STATEMENT_LENGTH:
                    short[name] = i
    return any_ | short | marked


def boundaries(lines: list[str]) -> list[tuple[int, str, bool]]:
    """(line, section, has prose) of the chosen headings in order of lines.

    Items are the heaviest chain of candidates whose lines and item order both rise; dropped sections get
    a second chance between the chosen ones. Statements stand wherever they are. In slices of
    ``RECOVERED_LINES`` lines or more a statement named outside the zone is recovered as well.
    """
    cand = candidates(lines)
    weighed = [(i, ORDER.get(name, len(ORDER)), name, float(max(1, PROSE_WEIGHT + s) if prose else 1)) for i, name, s, prose in cand]
    chosen = [cand[k] for k in heaviest(weighed)]
    held = {c[1] for c in chosen}
    rest = [c for c in cand if c[1] not in held]
    for c in rest:
        before = [x for x in chosen if x[0] < c[0]]
        after = [x for x in chosen if x[0] > c[0]]
        rank = ORDER.get(c[1], len(ORDER))
        if c[1] not in held and c[3] and all(ORDER.get(x[1], 0) < rank for x in before) and all(ORDER.get(x[1], 0) > rank for x in after):
            chosen = sorted([*chosen, c])
            held.add(c[1])
    out = {i: (name, prose) for i, name, _, prose in chosen}
    known = statements(lines)
    edges = sorted([*out, len(lines)])
    for a, b in zip(edges, edges[1:]):
        if b - a >= RECOVERED_LINES:
            for i in range(a + 1, b):
                line = lines[i].strip()
                name = section_of_text(line) if 0 < len(line) <= STATEMENT_LENGTH else None
                if name and name.startswith("fs_"):
                    known.setdefault(name, i)
    for name, i in known.items():
        out.setdefault(i, (name, True))
    return [(i, *out[i]) for i in sorted(out)]


def filing_sections(documents: DataFrame, doc: str, content: str, html: bool = False) -> DataFrame:
    """(doc, ord, section, part, line_no, until, chars, prose): the sections of every document.

    ``content`` is plain text, or HTML whose tables are taken out of the lines first. Several slices of a
    section are numbered by falling length, the longest keeps its plain name. Null contents have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = filing_lines(text, table_heads)[0] if html else text.split("\n")
                found = boundaries(lines)
                ends = [x[0] for x in found[1:]] + [len(lines)]
                sizes = [sum(len(x) for x in lines[i + 1 : e]) for (i, _, _), e in zip(found, ends)]
                order = sorted(range(len(found)), key=lambda k: (-sizes[k], k))
                seen: dict[str, int] = {}
                part = {}
                for k in order:
                    name = found[k][1]
                    seen[name] = seen.get(name, 0) + 1
                    part[k] = name if seen[name] == 1 else f"{name}__{seen[name]}"
                rows += [(d, k, found[k][1], part[k], found[k][0], ends[k], sizes[k], found[k][2]) for k in range(len(found))]
            types = [b.schema.types[0], pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[doc, "ord", "section", "part", "line_no", "until", "chars", "prose"])

    kind = dict(documents.dtypes)[doc]
    return documents.select(doc, content).filter(F.col(content).isNotNull()).mapInArrow(run, f"{doc} {kind}, ord int, section string, part string, line_no int, until int, chars long, prose boolean")


def table_heads(grid: list[list[str]]) -> list[str]:
    """Headings that a table hides in its cells: a statement's title in the first five rows, else item titles row by row.

    An item's number and title may stand in neighbouring cells; a row with a page number is no heading.
    """
    cells = lambda row: list(dict.fromkeys(c for c in row if c and len(c) <= HEADING_LENGTH))
    for row in grid[:5]:
        for c in cells(row):
            name = section_of_text(c)
            if name and name.startswith("fs_"):
                return [c]
    out = []
    for row in grid[:60]:
        texts = cells(row)
        joined = "".join(texts)
        for t in [*texts, joined]:
            if len(t) <= HEADING_LENGTH and _ITEM.match(t) and not re.search(r"\d\s*$", t) and _anchored(t)[1] and not _PAGE.search(joined) and not re.search(r"[a-z]\d{1,3}$", joined.lower()):
                out.append(t)
                break
    return out
