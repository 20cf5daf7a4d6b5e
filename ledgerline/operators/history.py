"""History of changing entity attributes (problem 5).

Snapshots are numbered per entity; consecutive snapshots are differenced by a null-safe full outer join
that classifies inserted, changed and deleted keys; the change events become versions whose end is the
``lead`` of the next version's begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.precision import explained, half_unit
from ..functions.text import accession_number, accession_text
from ..runtime import broadcast_if_small, cut
from .asof import filings_by_year
from .cells import agreed_cells
from .statements import half, statements

_WIDE = Context(prec=90)


def difference_snapshots(snapshots: DataFrame, key: list[str], number: str, same, older: list[str] | None = None) -> DataFrame:
    """Change events of numbered snapshots: (key..., number, change, old, new).

    ``snapshots`` hold one row per key and snapshot number, numbered 1, 2, ... per key. ``same(a, b)``
    gives the Column that is true if the structs a (older) and b (newer) state the same. A row is
    ``inserted`` if its key has no preceding snapshot, ``changed`` if it differs from it and ``deleted``
    for the number after a key's last row. Keys may be null; unchanged rows give no event. ``older``
    names the columns needed of the older snapshot (all, if not given).
    """
    cols = [c for c in snapshots.columns if c not in key]
    ks = [f"__k{i}" for i in range(len(key))]
    row = F.struct(*cols)
    newer = snapshots.select(*[F.col(k).alias(a) for k, a in zip(key, ks)], F.col(number).alias("__n"), row.alias("new"))
    before = snapshots.select(*[F.col(k).alias(a) for k, a in zip(key, ks)], (F.col(number) + 1).alias("__n"), F.struct(*(older or cols)).alias("old"))
    a, b = before.alias("a"), newer.alias("b")
    on = F.col("a.__n") == F.col("b.__n")
    for k in ks:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = a.join(b, on, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(c) for k, c in zip(ks, key)], F.coalesce("a.__n", "b.__n").alias(number), "old", "new")
    change = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").when(~same(F.col("old"), F.col("new")), "changed")
    return both.withColumn("change", change).filter("change is not null")


def validity(versions: DataFrame, key: list[str], number: str, begin: str, end: str = "closed_by") -> DataFrame:
    """Add ``end``: the ``begin`` of the key's next version, null for the version that still holds."""
    return versions.withColumn(end, F.lead(begin).over(Window.partitionBy(*key).orderBy(number)))


def _openers(key: list[str]):
    """mapInArrow function over rows sorted by key and number: keeps those that open a version.

    The version's opener is the only state, so a key of any length streams through.
    """

    def differs(v: Decimal, r: int | None, w: Decimal, q: int | None) -> bool:
        if v == w:
            return False
        a, b = half(r), half(q)
        return a is None or b is None or _WIDE.abs(_WIDE.subtract(v, w)) > _WIDE.add(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, value, rank = None, None, None
        for b in batches:
            at = [b.schema.get_field_index(c) for c in (*key, "value", "rank")]
            keep = []
            for i, row in enumerate(zip(*[b.column(j).to_pylist() for j in at])):
                k, v, r = row[:-2], row[-2], row[-1]
                if k != held or differs(value, rank, v, r):
                    held, value, rank = k, v, r
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return run


def _dictionary(rows: DataFrame, name: str, code: str) -> DataFrame:
    """(code, name) of distinct names under their 64-bit hash; two names under one hash raise."""
    named = rows.groupBy(F.xxhash64(name).alias(code)).agg(F.min(name).alias(name), F.max(name).alias("__other"))
    clash = F.when(F.col(name) != F.col("__other"), F.raise_error(F.lit(f"two values of {name} share a hash")))
    return named.select(code, F.coalesce(clash.cast("string"), F.col(name)).alias(name))


def restated_numbers(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """(cik, concept, end_date, accession, closed_by): every version of every numeric cell of a filer.

    Filings are taken by filing date, originals before amendments, deeper amendments later, then by
    accession. Facts of unlisted filings, or of filings without cik or date, say nothing. An accession
    travels as the whole number of its digits, a concept as a dictionary code that is looked up again
    only for the versions found. Cells are combined before they meet their filings, so the plan is the
    same whether the listing is sent around or shuffled. Cells with at most one change are settled by
    comparing neighbours and never reach Python.
    """
    order = F.unix_date("filing_date").cast("bigint") * (1 << 24) + F.col("amendment") * (1 << 23) + F.col("depth")
    listed = cut(filings_by_year(filings).filter("cik is not null and filing_date is not null").select(accession_number(F.col("accession")).alias("acc"), "cik", order.cast("bigint").alias("ord")))
    rows = statements(facts)
    concepts = cut(_dictionary(rows, "concept", "c"))
    coded = rows.withColumn("c", F.xxhash64("concept")).withColumn("acc", accession_number(F.col("accession"))).filter("acc is not null")
    cells = agreed_cells(coded, ["acc", "c", "end_date"], ["unit", "start_date"], texts=False)
    stated = cells.join(broadcast_if_small(listed, listed.count(), 40), "acc")
    key = ["cik", "c", "end_date"]
    whole = Window.partitionBy(*key)
    placed = stated.withColumn("n", F.row_number().over(whole.orderBy("ord", "acc"))).withColumn("__of", F.count(F.lit(1)).over(whole)).select(*key, "n", "acc", "value", "rank", "__of")
    # a cell with one snapshot has nothing to be differenced against; closed_by, always null here, refers to
    # all columns so that both branches ask for the same ones and share one exchange
    once = placed.filter("__of = 1").select(*key, "n", "acc", F.when((F.col("n") < 1) & F.col("value").isNull() & F.col("rank").isNotNull(), F.col("acc")).alias("closed_by"))
    numbered = placed.filter("__of > 1").drop("__of")
    same = lambda a, b: (a["value"] == b["value"]) & a["rank"].eqNullSafe(b["rank"])
    events = difference_snapshots(numbered, key, "n", same, older=["value", "rank"]).filter("change <> 'deleted' and c is not null").select(*key, "n", F.col("new.acc").alias("acc"), F.col("new.value").alias("value"), F.col("new.rank").alias("rank"))
    w = Window.partitionBy(*key).orderBy("n")
    seen = events.withColumn("__c", F.count(F.lit(1)).over(Window.partitionBy(*key))).withColumn("__v", F.lag("value").over(w)).withColumn("__r", F.lag("rank").over(w))
    differs = F.col("__v").isNull() | ~((F.col("__v") == F.col("value")) | explained(F.col("__v"), half_unit(F.col("__r")), F.col("value"), half_unit(F.col("rank"))))
    cols = [*key, "n", "acc"]
    few = validity(seen.filter((F.col("__c") <= 2) & differs).select(*cols), key, "n", "acc")
    many = seen.filter("__c > 2").select(*cols, "value", "rank").sortWithinPartitions(*key, "n")
    opened = many.mapInArrow(_openers(key), "cik bigint, c bigint, end_date date, n int, acc bigint, value decimal(38,10), rank int")
    found = once.unionByName(few).unionByName(validity(opened.select(*cols), key, "n", "acc"))
    return found.join(broadcast_if_small(concepts, concepts.count(), 96), "c").select(
        "cik", "concept", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), accession_text(F.col("acc")).alias("accession"), F.coalesce(accession_text(F.col("closed_by")), F.lit("")).alias("closed_by")
    )
