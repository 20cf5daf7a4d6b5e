"""Attribute-value rows into wide tables (problem 3).

Entities are hash-bucketed; in each bucket entity and attribute are dictionary-encoded, values are
scattered by row and column index into one numpy array per type, and the block leaves as an Arrow table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import agreed_cells
from .statements import statements

#: Types of columns, in the order in which a cell's value is tried.
KINDS = ("number", "date", "boolean", "text")
_ARROW = {"number": pa.decimal128(38, 10), "date": pa.date32(), "boolean": pa.bool_(), "text": pa.string()}
#: Rows of a block; bounds the arrays held at once however large a bucket is.
BLOCK_ROWS = 4096


def kind_of(value: Column, text: Column) -> Column:
    """Type of a cell: number if it has one, else what its text reads as."""
    t = F.trim(text)
    return F.when(value.isNotNull(), "number").when(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & t.try_cast("date").isNotNull(), "date").when(F.lower(t).isin("true", "false"), "boolean").otherwise("text")


#: Cells of a block's arrays; a block of more is cut into fewer entities.
BLOCK_CELLS = 4_000_000
#: A DECIMAL(38,10) as numpy holds it: the two halves of its 128 bits.
_DECIMAL = np.dtype([("low", "<u8"), ("high", "<i8")])


def _scattered(row: np.ndarray, column: np.ndarray, values: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """One typed array (columns x rows) with ``values`` at their places, and which places are filled."""
    out, filled = np.zeros((columns, rows), dtype=values.dtype), np.zeros((columns, rows), dtype=bool)
    out[column, row] = values
    filled[column, row] = True
    return out, filled


def _typed(kind: str, values: pa.Array) -> tuple[np.ndarray, pa.Array | None]:
    """Cell values of one type as a numpy array, and the dictionary that the codes of texts refer to."""
    if kind == "number":
        start = values.offset * 16
        return np.frombuffer(values.buffers()[1], dtype=_DECIMAL, count=len(values), offset=start), None
    if kind == "text":
        code = pc.dictionary_encode(values)
        return code.indices.to_numpy(zero_copy_only=False).astype(np.int32), code.dictionary
    text = pc.utf8_trim_whitespace(values)
    if kind == "date":
        return pc.cast(pc.cast(text, pa.date32()), pa.int32()).to_numpy(zero_copy_only=False), None
    return pc.equal(pc.utf8_lower(text), "true").to_numpy(zero_copy_only=False), None


def _arrow(kind: str, values: np.ndarray, filled: np.ndarray, dictionary: pa.Array | None) -> pa.Array:
    """One column of a scattered array as Arrow; places that were not filled are null."""
    if kind == "number":
        valid = pa.py_buffer(np.packbits(filled, bitorder="little").tobytes())
        return pa.Array.from_buffers(_ARROW[kind], len(values), [valid, pa.py_buffer(np.ascontiguousarray(values).tobytes())])
    if kind == "text":
        return pa.DictionaryArray.from_arrays(pa.array(values, mask=~filled), dictionary).cast(pa.string())
    return pa.array(values, mask=~filled).cast(_ARROW[kind]) if kind == "boolean" else pa.array(values, type=pa.int32(), mask=~filled).cast(pa.date32())


def block(cells: pa.Table, entity: list[str], attribute: str) -> Iterator[tuple[pa.Table, dict[str, tuple[str, str]]]]:
    """Wide Arrow tables of some entities' cells and, by column name, their (attribute, type).

    ``cells`` hold entity columns, attribute, ``kind`` and per-type values ``number`` and ``text``, sorted by
    entity. Entity and attribute are dictionary-encoded; the values of each type are scattered by row and
    column index into one array of that type. One table comes out, or several if the arrays of one would
    have more than ``BLOCK_CELLS`` places.
    """
    n = cells.num_rows
    codes = []
    for c in (*entity, attribute, "kind"):
        codes.append(pc.dictionary_encode(cells[c].combine_chunks(), null_encoding="encode"))
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    for a in codes[: len(entity)]:
        i = a.indices.to_numpy(zero_copy_only=False)
        change[1:] |= i[1:] != i[:-1]
    begins = np.flatnonzero(change)
    att, kind = (a.indices.to_numpy(zero_copy_only=False).astype(np.int64) for a in codes[-2:])
    kinds, names = codes[-1].dictionary.to_pylist(), codes[-2].dictionary.to_pylist()
    code = att * max(1, len(kinds)) + kind
    if len(begins) > 1 and len(begins) * len(np.unique(code)) > BLOCK_CELLS:
        middle = int(begins[len(begins) // 2])
        yield from block(cells.slice(0, middle), entity, attribute)
        yield from block(cells.slice(middle), entity, attribute)
        return
    row, rows = np.cumsum(change) - 1, len(begins)
    number, text = cells["number"].combine_chunks(), cells["text"].combine_chunks()
    out = {c: cells[c].combine_chunks().take(pa.array(begins)) for c in entity}
    meaning: dict[str, tuple[str, str]] = {}
    for k, name in enumerate(kinds):
        at = np.flatnonzero(kind == k)
        own, column = np.unique(att[at], return_inverse=True)
        values, dictionary = _typed(name, (number if name == "number" else text).take(pa.array(at)))
        scattered, filled = _scattered(row[at], column, values, rows, len(own))
        for j, a in enumerate(own):
            title = f"{names[a]}#{name}"
            out[title] = _arrow(name, scattered[j], filled[j], dictionary)
            meaning[title] = (names[a], name)
    yield pa.table(out), meaning


def wide_blocks(cells: DataFrame, entity: list[str], attribute: str, emit: Callable[[pa.Table, dict], pa.Table], schema: str) -> DataFrame:
    """Run ``emit`` on the wide Arrow table of every block of entities.

    ``cells`` hold at most one row per entity and attribute, with ``kind``, ``number`` and ``text``.
    Entities are hash-bucketed, so an entity is never in two blocks, and a block is cut at
    ``BLOCK_ROWS`` entities, so memory does not grow with a bucket. Null entity or attribute columns
    are values of their own; an empty input gives no blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < BLOCK_ROWS * 8:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            cut = _last_entity(t, entity)
            if cut:
                for made in block(t.slice(0, cut), entity, attribute):
                    yield from _checked(emit(*made))
            held = t.slice(cut).to_batches()
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            if t.num_rows:
                for made in block(t, entity, attribute):
                    yield from _checked(emit(*made))

    keyed = cells.repartition(*[F.col(c) for c in entity]).sortWithinPartitions(*entity)
    return keyed.mapInArrow(run, schema)


def _checked(t: pa.Table) -> list[pa.RecordBatch]:
    return t.combine_chunks().to_batches() if t.num_rows else []


def _last_entity(t: pa.Table, entity: list[str]) -> int:
    """Index at which the last entity of a sorted table begins."""
    last = [t[c][t.num_rows - 1] for c in entity]
    same = np.ones(t.num_rows, dtype=bool)
    for c, v in zip(entity, last):
        col = t[c].combine_chunks()
        m = pc.is_null(col) if not v.is_valid else pc.fill_null(pc.equal(col, v), False)
        same &= m.to_numpy(zero_copy_only=False)
    return int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0


def fact_cells(facts: DataFrame) -> DataFrame:
    """Typed cells (accession, end_date, concept, kind, number, text) of the facts that agree."""
    agreed = agreed_cells(statements(facts), ["accession", "end_date", "concept"], ["unit", "start_date"])
    return agreed.select("accession", "end_date", "concept", kind_of(F.col("value"), F.col("value_text")).alias("kind"), F.col("value").alias("number"), F.when(F.col("value").isNull(), F.col("value_text")).alias("text"))


def filled_cells(facts: DataFrame) -> DataFrame:
    """(accession, end_date, concept) of every filled cell of the wide table, read back from its blocks."""

    def emit(t: pa.Table, meaning: dict[str, tuple[str, str]]) -> pa.Table:
        parts = []
        day = pc.cast(t["end_date"], pa.string())
        for title, (name, _) in meaning.items():
            filled = pc.is_valid(t[title])
            at = t["accession"].filter(filled)
            parts.append(pa.table({"accession": at, "end_date": day.filter(filled), "concept": pa.repeat(pa.scalar(name, pa.string()), len(at))}))
        return pa.concat_tables(parts) if parts else pa.table({"accession": pa.array([], pa.string()), "end_date": pa.array([], pa.string()), "concept": pa.array([], pa.string())})

    return wide_blocks(fact_cells(facts), ["accession", "end_date"], "concept", emit, "accession string, end_date string, concept string")


def wide_table(cells: DataFrame, entity: list[str], attribute: str, columns: list[tuple[str, str]], titles: list[str] | None = None) -> DataFrame:
    """The wide table itself: entity columns and one typed column per (attribute, type) of ``columns``.

    Entities without any of the columns come out with nulls; attributes of other types stay out of a column.
    ``titles`` name the columns otherwise than by their attributes.
    """
    titles = titles or [a for a, _ in columns]
    spark_type = {"number": "decimal(38,10)", "date": "date", "boolean": "boolean", "text": "string"}
    kinds = dict(cells.dtypes)
    ddl = ", ".join([*[f"`{c}` {kinds[c]}" for c in entity], *[f"`{t}` {spark_type[k]}" for t, (_, k) in zip(titles, columns)]])

    def emit(t: pa.Table, meaning: dict[str, tuple[str, str]]) -> pa.Table:
        back = {v: k for k, v in meaning.items()}
        cols = [(c, t[c]) for c in entity]
        for name, (a, k) in zip(titles, columns):
            title = back.get((a, k))
            cols.append((name, t[title] if title else pa.nulls(t.num_rows, _ARROW[k])))
        return pa.Table.from_arrays([c for _, c in cols], names=[n for n, _ in cols])

    return wide_blocks(cells, entity, attribute, emit, ddl)


def all_columns(cells: DataFrame, attribute: str) -> list[tuple[str, str]]:
    """Every (attribute, type) of ``cells`` in order: the columns of the whole wide table.

    This is the dictionary of the attributes, which bounds the width of any table that holds them all.
    """
    return sorted((r[0], r[1]) for r in attribute_types(cells, attribute).select(attribute, "kind").collect() if r[0] is not None)


def whole_table(cells: DataFrame, entity: list[str], attribute: str) -> DataFrame:
    """The wide table with every column that ``cells`` have, named by attribute, and ``attribute#type`` where an attribute has several types."""
    columns = all_columns(cells, attribute)
    several = {a for a, k in columns if sum(x == a for x, _ in columns) > 1}
    titles = [(f"{a}#{k}" if a in several else a) for a, k in columns]
    return wide_table(cells, entity, attribute, columns, titles)


def write_wide(cells: DataFrame, entity: list[str], attribute: str, path: str) -> None:
    """Write the whole wide table as Parquet."""
    whole_table(cells, entity, attribute).write.mode("overwrite").parquet(path)


def attribute_types(cells: DataFrame, attribute: str) -> DataFrame:
    """(attribute, kind, cells): the dictionary of columns a wide table of ``cells`` would have."""
    return cells.groupBy(attribute, "kind").agg(F.count(F.lit(1)).alias("cells"))
