"""Assignment of section headings: the heaviest increasing subsequence of candidates per document."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heaviest(candidates: list[tuple[int, int, str, float]]) -> list[int]:
    """Indices of the chosen (line, priority, id, weight) candidates: lines and priorities strictly increase.

    Candidates are taken by (line, priority, id). A Fenwick-like frontier keeps, by priority, the best
    total of chains that end on an earlier line, so the cost is n log n; of equal totals the chain that
    ends first wins.
    """
    order = sorted(range(len(candidates)), key=lambda i: candidates[i][:3])
    ends: list[int] = []  # priorities of the frontier, rising, with rising totals
    best: list[tuple[float, int]] = []
    total: dict[int, float] = {}
    before: dict[int, int | None] = {}
    at = 0
    while at < len(order):
        line = candidates[order[at]][0]
        group = []
        while at < len(order) and candidates[order[at]][0] == line:
            i = order[at]
            k = bisect_left(ends, candidates[i][1])
            t, prev = (best[k - 1] if k else (0.0, None))
            total[i], before[i] = t + candidates[i][3], prev
            group.append(i)
            at += 1
        for i in group:  # chains may not hold two candidates of one line
            p, t = candidates[i][1], total[i]
            k = bisect_right(ends, p)
            if k and best[k - 1][0] >= t:
                continue
            j = bisect_left(ends, p)
            while j < len(ends) and best[j][0] <= t:
                del ends[j], best[j]
            ends.insert(j, p)
            best.insert(j, (t, i))
    if not best:
        return []
    chosen, i = [], best[-1][1]
    while i is not None:
        chosen.append(i)
        i = before[i]
    return chosen[::-1]


def assign(candidates: DataFrame, doc: str) -> DataFrame:
    """Chosen candidates (doc, line_no, priority, section) of every document.

    ``candidates`` hold doc, line_no, priority, section, weight. A document's candidates are the headings
    of one filing; they stream through sorted tasks one document at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        schema = None

        def done() -> list[tuple]:
            keep = heaviest([(r[1], r[2], r[3], r[4]) for r in rows])
            return [rows[i][:4] for i in keep]

        for b in batches:
            schema = b.schema
            out = []
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if r[0] != held:
                    out += done() if rows else []
                    held, rows = r[0], []
                rows.append(r)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], schema.types[i]) for i in range(4)], names=schema.names[:4])
        if rows:
            out = done()
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], schema.types[i]) for i in range(4)], names=schema.names[:4])

    kind = dict(candidates.dtypes)[doc]
    arranged = candidates.select(doc, F.col("line_no").cast("long"), F.col("priority").cast("long"), "section", F.col("weight").cast("double")).repartition(doc).sortWithinPartitions(doc, "line_no", "priority", "section")
    return arranged.mapInArrow(run, f"{doc} {kind}, line_no long, priority long, section string")
