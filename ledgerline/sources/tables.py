"""HTML tables as grids and as Markdown."""

from __future__ import annotations

from html.parser import HTMLParser


class _Tables(HTMLParser):
    """Cells of every outermost table, each as (text, colspan, rowspan)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[list[list[tuple[str, int, int]]]] = []
        self.rows: list[list[tuple[str, int, int]]] = []
        self.depth = 0
        self.cell: list[str] | None = None
        self.spans = (1, 1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.rows = []
        elif self.depth == 1 and tag == "tr":
            self._close()
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._close()
            if not self.rows:
                self.rows.append([])
            self.cell, self.spans = [], tuple(max(1, min(1000, int(v))) if (v := a.get(k) or "1").isdigit() else 1 for k in ("colspan", "rowspan"))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr") and self.depth == 1:
            self._close()
        elif tag == "table" and self.depth:
            if self.depth == 1:
                self._close()
                self.done.append(self.rows)
            self.depth -= 1

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)

    def _close(self) -> None:
        if self.cell is not None:
            self.rows[-1].append((" ".join(" ".join(self.cell).split()), *self.spans))
            self.cell = None


def grids(html: str) -> list[list[list[str]]]:
    """Every table as a rectangular grid: spanned cells repeat their text, missing ones are empty."""
    p = _Tables()
    p.feed(html)
    p.close()
    out = []
    for rows in p.done:
        grid: dict[tuple[int, int], str] = {}
        for r, row in enumerate(rows):
            c = 0
            for text, wide, tall in row:
                while (r, c) in grid:
                    c += 1
                for i in range(tall):
                    for j in range(wide):
                        grid.setdefault((r + i, c + j), text)
                c += wide
        height, width = len(rows), max((c for _, c in grid), default=-1) + 1
        out.append([[grid.get((r, c), "") for c in range(width)] for r in range(height)])
    return out


def is_data(grid: list[list[str]], least_text: int = 60) -> bool:
    """True for tables worth keeping: two rows, two cells in the first, and some text; others are layout."""
    return len(grid) >= 2 and len(grid[0]) >= 2 and sum(len(c) for row in grid for c in row) > least_text


def markdown(grid: list[list[str]]) -> str:
    """Markdown of a grid; heads that are mere numbers are left blank."""
    head = ["" if c.replace(".", "").isdigit() and len(c) < 3 else c for c in grid[0]]
    lines = [head, ["---"] * len(head), *grid[1:]]
    return "\n".join("| " + " | ".join(c.replace("|", "/") for c in row) + " |" for row in lines)


#: Tags that end a line of text.
_BLOCKS = frozenset("p div tr br li h1 h2 h3 h4 h5 h6 hr section article body html title".split())


class _Lines(HTMLParser):
    """Text lines of a page; the place of every outermost table is kept and its content left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.depth = 0
        self.tables = 0
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            if not self.depth:
                self.parts.append(f"\n\x00{self.tables}\n")
                self.tables += 1
            self.depth += 1
        elif tag in ("script", "style"):
            self.silent += 1
        elif tag in _BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag in _BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.depth and not self.silent:
            self.parts.append(data)


def filing_lines(html: str, heads) -> tuple[list[str], list[list[list[str]]]]:  # noqa: ANN001
    """Lines of a page and its data tables as grids.

    In the place of a table stand the headings that ``heads`` finds in it, marked as such, and a numbered
    placeholder if it holds data; layout tables leave nothing but those headings.
    """
    page = _Lines()
    page.feed(html)
    page.close()
    found = grids(html)
    lines: list[str] = []
    kept: list[list[list[str]]] = []
    for line in "".join(page.parts).split("\n"):
        line = " ".join(line.split()) if "\x00" not in line else line
        if line.startswith("\x00"):
            at = int(line[1:])
            grid = found[at] if at < len(found) else []
            lines += [f"\u00a7\u00a7 {h}" for h in heads(grid)]
            if is_data(grid):
                lines.append(f"<<<TABLE_{len(kept)}>>>")
                kept.append(grid)
        elif line or (lines and lines[-1]):
            lines.append(line)
    return lines, kept
