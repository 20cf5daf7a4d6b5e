"""Best representative of each duplicate group (problem 2).

``representatives`` turns records that state one quantity into one record. Each candidate group is
put in its topological order (declared precision first, then the least id) and folded: the latest
element of the order survives, takes its duplicates with it and is completed from them field by field;
what is left over is judged again. ``learn_precedence`` and ``latest_values`` are the currency-reasoning
part for attributes whose order is not declared: precedence between values is learned from timestamped
rows and used to find the latest value where timestamps are missing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from decimal import Context, Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.precision import half_unit
from ..operators.statements import half as _half
from ..operators.statements import statements
from ..runtime import broadcast_if_small, cut

#: Groups with more records than this are pre-aggregated and cut along the value axis.
HOT_ROWS = 20_000
#: Pieces into which a hot group's value range is cut, at approximate quantiles.
HOT_PIECES = 64
_WIDE = Context(prec=90)


class Fold:
    """Survivors of one group, each ``[id, size, fields...]``, from its records in topological order.

    Records are (id, rank, value, text, size, sources, fields...), best first. ``sources`` has the id each
    field comes from, if the record stands for several; None means its own. A blank field is filled from
    the next best record that has it: by rank, then by the id it comes from. Only survivors are kept, by
    exact statement and, for declared numbers, sorted by value, so that a record meets only survivors
    within reach and a group of any size passes as a stream.
    """

    def __init__(self) -> None:
        self.out: list[list] = []
        self.exact: dict[tuple, int] = {}
        self.by_value: list[tuple[Decimal, int]] = []
        self.reach = Decimal(0)
        self.halves: list[Decimal] = []
        self.origins: list[list[tuple]] = []

    def add(self, ident: int, rank: int | None, value: Decimal | None, text: str | None, size: int, sources: list | None, *fields) -> None:  # noqa: ANN002
        half = _half(rank)
        at = self.exact.get((value, text))
        if value is not None and half is not None and self.by_value:
            low = _WIDE.subtract(_WIDE.subtract(value, half), self.reach)
            high = _WIDE.add(_WIDE.add(value, half), self.reach)
            i = bisect_left(self.by_value, (low, -1))
            while i < len(self.by_value) and self.by_value[i][0] <= high:
                v, k = self.by_value[i]
                if (at is None or k < at) and _WIDE.abs(_WIDE.subtract(v, value)) <= _WIDE.add(half, self.halves[k]):
                    at = k
                i += 1
        if at is None:
            at = len(self.out)
            self.out.append([ident, size, *fields])
            self.origins.append([(rank, i) for i in sources or [ident] * len(fields)])
            self.halves.append(half if half is not None else Decimal(0))
            self.exact[(value, text)] = at
            if value is not None and half is not None:
                insort(self.by_value, (value, at))
                self.reach = max(self.reach, half)
            return
        kept, origin = self.out[at], self.origins[at]
        kept[1] += size
        for j, f in enumerate(fields):
            if f is None:
                continue
            source = sources[j] if sources else ident
            # ranks only fall from record to record, so a held field can be beaten only within its own rank
            if kept[j + 2] is None or (origin[j][0] == rank and source < origin[j][1]):
                kept[j + 2], origin[j] = f, (rank, source)


def fold(records: list[tuple]) -> list[list]:
    """Survivors of the records of one group, see ``Fold``."""
    f = Fold()
    for r in records:
        f.add(*r)
    return f.out


def _fold_sorted(fields: list[str], schema: pa.Schema):
    """mapInArrow function over rows sorted by (g1, g2, piece) and order: folds each run of equal groups as it passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, done = None, Fold(), []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(schema.types)], schema=schema)

        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("g1", "g2", "piece", "id", "rank", "value", "value_text", "size", "sources", *fields)]
            for row in zip(*cols):
                if row[:3] != key:
                    done += [r for r in group.out if r[1] > 1]
                    key, group = row[:3], Fold()
                group.add(*row[3:])
            if len(done) > 10_000:
                yield emit()
                done = []
        done += [r for r in group.out if r[1] > 1]
        yield emit()

    return run


def _pieces(hot: DataFrame, fields: list[str]) -> DataFrame:
    """Hot groups without exact repetitions, with a ``piece`` such that duplicates never lie in two pieces.

    Repeated statements are combined map-side first; ``sources`` keeps the id that each of their fields
    comes from. The value axis of each group is cut at approximate
    quantiles; within a cut, a piece begins where no earlier interval value ± half unit reaches. The
    intervals of earlier cuts enter as one number per cut, so no window ever spans a whole hot group.
    """
    keys = ["g1", "g2"]
    firsts = [F.min(F.when(F.col(f).isNotNull(), F.struct("id", F.col(f).alias("f")))).alias(f"__{f}") for f in fields]
    one = hot.groupBy(*keys, "value", "value_text", "rank").agg(F.min("id").alias("id"), F.sum("size").alias("size"), *firsts)
    one = one.select(*keys, "value", "value_text", "rank", "id", "size", F.array(*[F.col(f"__{f}.id") for f in fields]).cast("array<bigint>").alias("sources"), *[F.col(f"__{f}.f").alias(f) for f in fields])
    texts = one.filter("value is null").withColumn("piece", F.xxhash64("value_text"))
    numbers = one.filter("value is not null")
    at = [i / HOT_PIECES for i in range(1, HOT_PIECES)]
    cuts = numbers.groupBy(*keys).agg(F.percentile_approx(F.col("value").cast("double"), at, 1000).alias("__cuts"))
    half = F.coalesce(half_unit(F.col("rank")), F.lit(0).cast("decimal(38,10)"))
    numbers = numbers.join(cuts, keys).withColumn("__cut", F.size(F.filter("__cuts", lambda x: x < F.col("value").cast("double")))).withColumn("__lo", F.col("value") - half).withColumn("__hi", F.col("value") + half).drop("__cuts")
    tops = numbers.groupBy(*keys, "__cut").agg(F.max("__hi").alias("__top"), F.min("__lo").alias("__bottom"))
    # intervals of later cuts may begin below this cut's values: lower starts are treated as reaching back
    earlier = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(1, Window.unboundedFollowing)
    reach = tops.select(*keys, "__cut", F.max("__top").over(earlier).alias("__before"), F.min("__bottom").over(later).alias("__after"))
    numbers = numbers.join(reach, [*keys, "__cut"])
    inside = Window.partitionBy(*keys, "__cut").orderBy("value", "id")
    upto = F.greatest(F.max("__hi").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("__before"))
    ahead = F.least(F.min("__lo").over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)), F.col("__after"))
    numbers = numbers.withColumn("__start", F.coalesce(ahead > upto, F.lit(True)))
    local = F.sum(F.col("__start").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbers = numbers.withColumn("__n", local)
    starts = numbers.groupBy(*keys, "__cut").agg(F.max("__n").alias("__n"))
    offsets = starts.select(*keys, "__cut", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__o"))
    numbers = numbers.join(offsets, [*keys, "__cut"]).withColumn("piece", F.col("__n") + F.col("__o"))
    cols = [*keys, "piece", "id", "rank", "value", "value_text", "size", "sources", *fields]
    return numbers.select(*cols).unionByName(texts.select(*cols))


def representatives(rows: DataFrame, keys: list[str], fields: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(kept_id, size, fields...): one row per group of two or more duplicates among ``rows``.

    ``rows`` have ``keys``, ``id``, ``rank``, ``value``, ``value_text`` and ``fields``. Nulls in keys are
    a value of their own. Groups are told apart by 128 hash bits of the keys. Groups of more than
    ``hot_rows`` records are found by a counting pass with map-side combination and treated piecewise.
    Empty inputs give an empty result; extra columns are ignored; exact repetitions of a record with one
    id count as two records.
    """
    named = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]
    base = rows.select(F.xxhash64(*named).alias("g1"), F.xxhash64(F.lit(7), *reversed(named)).alias("g2"), "id", "rank", "value", "value_text", F.lit(1).cast("long").alias("size"), F.lit(None).cast("array<bigint>").alias("sources"), *fields)
    hot = cut(rows.groupBy(F.xxhash64(*named).alias("g1")).count().filter(F.col("count") > hot_rows).select("g1"))
    n_hot = hot.count()
    whole = base.withColumn("piece", F.lit(0).cast("long"))
    if n_hot:
        small = broadcast_if_small(hot, n_hot, 16)
        whole = base.join(small, "g1", "left_anti").withColumn("piece", F.lit(0).cast("long")).unionByName(_pieces(base.join(small, "g1", "left_semi"), fields))
    group = Window.partitionBy("g1", "g2", "piece")
    order = [F.col("rank").desc_nulls_last(), F.col("id")]
    several = whole.withColumn("__n", F.count(F.lit(1)).over(group)).filter((F.col("__n") > 1) | (F.col("size") > 1))
    arranged = several.drop("__n").sortWithinPartitions("g1", "g2", "piece", *order)
    schema = pa.schema([("kept_id", pa.int64()), ("size", pa.int64()), *[(f, pa.string()) for f in fields]])
    ddl = ", ".join(["kept_id long, size long", *[f"{f} string" for f in fields]])
    return arranged.mapInArrow(_fold_sorted(fields, schema), ddl)


def duplicate_facts(facts: DataFrame) -> DataFrame:
    """(kept_id, context_id, source_doc, element_id) of each group of two or more duplicate facts."""
    found = representatives(statements(facts), ["accession", "unit", "start_date", "end_date", "concept"], ["context_id", "source_doc", "element_id"])
    return found.drop("size")


def learn_precedence(rows: DataFrame, entity: list[str], attribute: str, value: str, time: str) -> DataFrame:
    """(attribute, older, newer, support): learned currency order of values from timestamped rows.

    Consecutive different values of an entity's attribute are transitions; a transition is a precedence
    if it occurs more often than its reverse. Rows with a null value or time teach nothing; of several
    values of one time the least counts.
    """
    known = rows.filter(F.col(value).isNotNull() & F.col(time).isNotNull()).groupBy(*entity, attribute, time).agg(F.min(value).alias("newer"))
    w = Window.partitionBy(*entity, attribute).orderBy(time)
    moves = known.withColumn("older", F.lag("newer").over(w)).filter("older <> newer").groupBy(attribute, "older", "newer").agg(F.count(F.lit(1)).alias("support"))
    back = moves.select(attribute, F.col("older").alias("newer"), F.col("newer").alias("older"), F.col("support").alias("__back"))
    return moves.join(back, [attribute, "older", "newer"], "left").filter("__back is null or support > __back").select(attribute, "older", "newer", "support")


def closed_precedence(precedence: DataFrame, attribute: str) -> DataFrame:
    """(attribute, older, newer): every precedence that follows from the learned ones, by iterated joins.

    A round doubles the length of the chains followed. Values that precede one another both ways, in a
    cycle, have no order between them. The closure grows with the square of a chain of values at most,
    not with the rows that hold them.
    """
    state = cut(precedence.select(attribute, "older", "newer").distinct())
    known = state.count()
    while True:
        on = state.withColumnRenamed("newer", "__mid").join(state.select(attribute, F.col("older").alias("__mid"), "newer"), [attribute, "__mid"])
        state = cut(state.unionByName(on.select(attribute, "older", "newer")).distinct())
        grown = state.count()
        if grown == known:
            break
        known = grown
    back = state.select(attribute, F.col("older").alias("newer"), F.col("newer").alias("older"))
    return state.join(back, [attribute, "older", "newer"], "left_anti").filter("older <> newer")


def latest_values(groups: DataFrame, group: list[str], attribute: str, value: str, precedence: DataFrame) -> DataFrame:
    """(group..., attribute, latest): the topologically latest value of each group's attribute.

    A group's partial order holds between its values wherever one precedes another in the closure of the
    learned ``precedence``, whether or not the group holds the values between them. A value that precedes
    another of the group is dropped; of the maximal ones that which follows most values of the group and
    then the least is taken. Groups of a single value need no order and take no part in the joins; rows
    with a null value hold none; empty input gives no groups.
    """
    keys = [*group, attribute]
    held = groups.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v")).distinct()
    counted = held.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    several = counted.filter("__n > 1").drop("__n")
    closed = closed_precedence(precedence, attribute)
    older = several.withColumnRenamed("v", "older").join(closed, [attribute, "older"])
    inside = older.join(several.withColumnRenamed("v", "newer"), [*keys, "newer"], "left_semi")
    lost = inside.groupBy(*keys, F.col("older").alias("v")).agg(F.lit(1).alias("__lost"))
    follows = inside.groupBy(*keys, F.col("newer").alias("v")).agg(F.count(F.lit(1)).alias("__follows"))
    scored = several.join(lost, [*keys, "v"], "left_anti").join(follows, [*keys, "v"], "left")
    best = F.min(F.struct(-F.coalesce("__follows", F.lit(0)), "v"))
    latest = scored.groupBy(*keys).agg(best.alias("__b")).select(*keys, F.col("__b.v").alias("latest"))
    return counted.filter("__n = 1").select(*keys, F.col("v").alias("latest")).unionByName(latest)
