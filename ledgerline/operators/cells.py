"""One value per cell of raw statements: the agreement test shared by the wide table and the history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.precision import EXACT, half_unit


def _step() -> Column:
    """Factor by which declared precision outweighs an id in an exact decimal."""
    return F.lit("1" + "0" * 19).cast("decimal(20,0)")


def _ordering(rank: Column, ident: Column) -> Column:
    """Exact decimal that is least for the greatest declared precision and then the least id."""
    place = F.when(rank.isNull(), F.lit(2 * EXACT + 1)).otherwise(F.lit(EXACT) - F.greatest(F.least(rank, F.lit(EXACT)), F.lit(-EXACT)))
    return place.cast("decimal(6,0)") * _step() + ident.cast("decimal(20,0)")


def _rank_of(order: Column) -> Column:
    place = F.floor(order / _step()).cast("int")
    return F.when(place <= 2 * EXACT, F.lit(EXACT) - place)


#: Rows from which a key is hot, and keys followed at once to find such keys.
HOT_ROWS = 50_000
TRACKED = 20_000


def hot_keys(rows: DataFrame, keys: list[str], least: int = HOT_ROWS) -> list[int]:
    """Hashes of keys with more than about ``least`` rows, and at least every key with a 1,000th of all rows.

    A heavy-hitter sketch of fixed size is filled by each task; nothing else is shuffled or sent to the driver.
    """
    top = rows.select(F.xxhash64(*keys).alias("h")).agg(F.expr(f"approx_top_k(h, 1000, {TRACKED})").alias("top")).first()
    return [r["item"] for r in (top["top"] or []) if r["item"] is not None and r["count"] > least]


def agreed_cells(rows: DataFrame, keys: list[str], context: list[str], texts: bool = True) -> DataFrame:
    """(keys..., value, rank, value_text): cells whose records are all duplicates of the best.

    ``rows`` as of ``statements.statements``. A cell is left out if its records differ in a ``context``
    column (nulls are a value of their own), mix numbers and texts, or differ from the best record by
    more than declared precision explains. Everything is expressed in primitive aggregates: declared
    numbers through the narrowest interval value ± half unit, undeclared ones and texts through their
    least and greatest. Hot cells (``hot_keys``) are combined map-side before the shuffle; all others
    are shuffled as rows, which are half as wide as aggregation buffers. Numbers that come
    with differing texts agree only if all of them are declared. Without ``texts`` only cells of numbers
    are returned. Rows with a null key form cells of their own; empty input gives no cells.
    """
    none = F.lit(-(1 << 31))  # stands for null; no date or hash of a value in use is that small
    kinds = dict(rows.dtypes)
    ctx = [F.coalesce(F.unix_date(c), none) if kinds[c] == "date" else F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))) for c in context]
    slim = rows.select(*keys, *[x.alias(f"c{i}") for i, x in enumerate(ctx)], F.xxhash64(F.coalesce("value_text", F.lit("\u0000"))).alias("t"), "value", "rank", "id", *(["value_text"] if texts else []))
    half = half_unit(F.col("rank"))
    number = F.col("value").isNotNull()
    declared = number & F.col("rank").isNotNull()
    order = _ordering(F.col("rank"), F.col("id"))
    aggs = [
        *[f(f"c{i}").alias(f"c{i}_{f.__name__}") for i in range(len(ctx)) for f in (F.min, F.max)], F.min("t").alias("t0"), F.max("t").alias("t1"),
        F.count(F.when(number, 1)).alias("numbers"), F.count(F.lit(1)).alias("n"),
        F.max(F.when(declared, F.col("value") - half)).alias("lo"), F.min(F.when(declared, F.col("value") + half)).alias("hi"),
        F.min(F.when(~declared, F.col("value"))).alias("u0"), F.max(F.when(~declared, F.col("value"))).alias("u1"),
        F.min_by("value", order).alias("value"), F.min(order).alias("o"),
    ]
    if texts:
        aggs.append(F.min("value_text").alias("value_text"))
    hot = hot_keys(rows, keys)
    if hot:
        is_hot = F.xxhash64(*keys).isin(hot)
        cells = slim.filter(~is_hot).repartition(*keys).groupBy(*keys).agg(*aggs).unionByName(slim.filter(is_hot).groupBy(*keys).agg(*aggs))
    else:
        cells = slim.repartition(*keys).groupBy(*keys).agg(*aggs)
    cells = cells.withColumn("rank", _rank_of(F.col("o")))
    best_half = F.coalesce(half_unit(F.col("rank")), F.lit(0).cast("decimal(38,10)"))
    one_text = F.col("t0") == F.col("t1")
    within = F.col("lo").isNull() | ((F.col("lo") <= F.col("value") + best_half) & (F.col("hi") >= F.col("value") - best_half))
    equal = F.col("u0").isNull() | (one_text & (F.col("u0") == F.col("value")) & (F.col("u1") == F.col("value")))
    numeric = (F.col("numbers") == F.col("n")) & within & equal
    agreed = numeric | ((F.col("numbers") == 0) & one_text) if texts else numeric
    for i in range(len(ctx)):
        agreed = agreed & (F.col(f"c{i}_min") == F.col(f"c{i}_max"))
    return cells.filter(agreed).select(*keys, "value", "rank", *(["value_text"] if texts else []))
