"""Filling fixed-capacity containers with items (problem 7).

Bulk-synchronous best fit. Sizes are whole numbers bounded by the capacity, so the range sort of
documents and of gaps is a counting sort: documents are ranked within their size class in parallel, and
gaps are kept as runs of equal containers. A superstep takes the size classes from the largest down,
sweeps the sorted gaps for the successor of the size (the least gap that holds it), gives the k-th
document of the class to the k-th place of the run (conflicts are resolved by rank), updates the gaps
and repeats until every class is placed. Each budget's sweep is one task over its class counts, at most
one row a size whatever the number of documents; its runs stay distributed, and every document finds its
run by a join on budget and size.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import broadcast_if_small, cut

#: Vocabulary file of a public tokenizer, on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items that one task ranks within a size class, about; a class of any share of the rows is ranked in that many parts.
RANKED_AT_ONCE = 250_000
_encoders: dict[str, object] = {}


def _encoder(path: str):  # noqa: ANN202
    if path not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(documents: DataFrame, ident: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(ident, tokens): length of every text in tokens of a public tokenizer; a null text has none.

    Rows with a null id are left out. Whole texts are counted, each distinct text of a batch once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary)
        for b in batches:
            code = b.column(1).dictionary_encode()
            n = np.array([len(enc.encode_ordinary(t)) for t in code.dictionary.to_pylist()] + [0], dtype=np.int64)
            index = code.indices.fill_null(len(n) - 1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n[index])], names=["ident", "tokens"])

    kind = dict(documents.dtypes)[ident]
    return documents.select(F.col(ident).alias("ident"), F.col(text).alias("text")).filter("ident is not null").mapInArrow(run, f"ident {kind}, tokens bigint")


def plan(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit runs (size, first rank, items, first container, items per container) and the number of containers.

    ``sizes`` maps a size of 1 to ``capacity`` to its number of items.
    """
    gaps: list[int] = []
    at: dict[int, list[tuple[int, int]]] = {}
    runs, opened = [], 0

    def put(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in at:
                insort(gaps, gap)
                at[gap] = []
            at[gap].append((first, count))

    for size in sorted(sizes, reverse=True):
        left, rank = sizes[size], 0
        while left:
            i = bisect_left(gaps, size)
            if i < len(gaps):
                gap = gaps[i]
                first, count = at[gap].pop()
                if not at[gap]:
                    del at[gap], gaps[i]
            else:
                gap, first = capacity, opened
                count = max(1, left // (capacity // size))
                opened += count
            each = gap // size
            filled = min(count, left // each)
            if filled:
                runs.append((size, rank, filled * each, first, each))
                put(gap - each * size, first, filled)
            else:
                each, filled = left, 1
                runs.append((size, rank, left, first, left))
                put(gap - left * size, first, 1)
            put(gap, first + filled, count - filled)
            rank += filled * each
            left -= filled * each
    return runs, opened


_RUN = "b int, size bigint, first bigint, upto bigint, container bigint, per bigint"
_RUN_ARROW = pa.schema([("b", pa.int32()), *[(n, pa.int64()) for n in ("size", "first", "upto", "container", "per")]])


def planned_runs(counts: DataFrame) -> DataFrame:
    """(b, size, first, upto, container, per): which ranks of a size class go to which containers.

    ``counts`` holds (b, cap, size, n), one row per budget and size class. The ranks from ``first`` up to
    ``upto`` fill the containers from ``container`` on with ``per`` items each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cap, sizes = None, 0, {}

        def done() -> pa.RecordBatch:
            runs = plan(sizes, cap)[0]
            cols = [[held] * len(runs), [r[0] for r in runs], [r[1] for r in runs], [r[1] + r[2] for r in runs], [r[3] for r in runs], [r[4] for r in runs]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _RUN_ARROW.types)], schema=_RUN_ARROW)

        for batch in batches:
            for b, c, size, n in zip(*[x.to_pylist() for x in batch.columns]):
                if b != held:
                    if sizes:
                        yield done()
                    held, cap, sizes = b, c, {}
                sizes[size] = n
        if sizes:
            yield done()

    return counts.select(F.col("b").cast("int"), "cap", "size", "n").repartition("b").sortWithinPartitions("b").mapInArrow(run, _RUN)


def pack(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, ident, part, container, tokens): every item in containers of every budget's capacity.

    ``sized`` holds (ident, tokens), ``budgets`` holds (budget_id, capacity_tokens) and is small by
    definition. An item is split only if it alone exceeds the capacity: into full containers named
    ``ident/part`` and, as its last part, a remainder that is packed like an item. Shared containers are
    named ``#n``. Items without tokens go to ``#0``. Null sizes count as 0; budgets without a positive
    capacity are left out; repeated items are items of their own; empty inputs give an empty result.
    Capacities may be of any size.
    """
    spark = sized.sparkSession
    caps = {r[0]: r[1] for r in budgets.select("budget_id", "capacity_tokens").filter("budget_id is not null and capacity_tokens > 0").distinct().collect()}
    kind = dict(sized.dtypes)["ident"]
    if not caps:
        return spark.createDataFrame([], f"budget_id int, ident {kind}, part bigint, container string, tokens bigint")
    order = sorted(caps)
    options = F.array(*[F.struct(F.lit(i).alias("b"), F.lit(caps[b]).cast("bigint").alias("cap")) for i, b in enumerate(order)])
    salts = max(1, -(-sized.count() // RANKED_AT_ONCE))
    salted = sized.select("ident", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.pmod(F.xxhash64("ident"), F.lit(salts)).alias("salt"))
    items = salted.withColumn("x", F.explode(options)).select("ident", "tokens", "salt", "x.b", "x.cap")
    items = items.withColumn("whole", F.when(F.col("tokens") > F.col("cap"), F.floor(F.col("tokens") / F.col("cap"))).otherwise(F.lit(0)))
    items = items.withColumn("size", F.col("tokens") - F.col("whole") * F.col("cap"))
    # one count per (size, salt): offsets of the salts and the classes' totals
    counts = cut(items.filter("size > 0").groupBy("b", "size", "salt").agg(F.count(F.lit(1)).alias("n"), F.first("cap").alias("cap")))
    runs = cut(planned_runs(counts.groupBy("b", "size").agg(F.sum("n").alias("n"), F.first("cap").alias("cap"))))
    before = Window.partitionBy("b", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("b", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = items.filter("size > 0").withColumn("r", F.row_number().over(Window.partitionBy("b", "size", "salt").orderBy("ident")))
    if salts > 1:
        ranked = ranked.join(offsets, ["b", "size", "salt"])
    placed = ranked.withColumn("rank", F.col("r") - 1 + (F.col("offset") if salts > 1 else F.lit(0))).select("b", "size", "ident", "whole", "rank").alias("p")
    meets = (F.col("p.b") == F.col("q.b")) & (F.col("p.size") == F.col("q.size")) & (F.col("p.rank") >= F.col("q.first")) & (F.col("p.rank") < F.col("q.upto"))
    found = placed.join(broadcast_if_small(runs, runs.count(), 56).alias("q"), meets).select("p.*", (F.col("q.container") + F.floor((F.col("p.rank") - F.col("q.first")) / F.col("q.per"))).cast("bigint").alias("at"))
    name = F.get(F.array(*[F.lit(b) for b in order]), F.col("b")).cast("int").alias("budget_id")
    tails = found.select(name, "ident", F.col("whole").cast("bigint").alias("part"), F.concat(F.lit("#"), F.col("at").cast("string")).alias("container"), F.col("size").alias("tokens"))
    full = items.filter("whole > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("whole") - 1))).select(name, "ident", F.col("part").cast("bigint").alias("part"), F.concat_ws("/", F.col("ident").cast("string"), "part").alias("container"), F.col("cap").alias("tokens"))
    nothing = items.filter("tokens = 0").select(name, "ident", F.lit(0).cast("bigint").alias("part"), F.lit("#0").alias("container"), F.lit(0).cast("bigint").alias("tokens"))
    return tails.unionByName(full).unionByName(nothing)


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, containers, tokens, least_containers, filled): how well each budget's containers are used."""
    per = packed.groupBy("budget_id", "container").agg(F.sum("tokens").alias("t"))
    total = per.groupBy("budget_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    cap = F.col("capacity_tokens")
    return total.join(budgets.select("budget_id", "capacity_tokens").distinct(), "budget_id").select("budget_id", "containers", "tokens", F.ceil(F.col("tokens") / cap).alias("least_containers"), (F.col("fullest") <= cap).alias("fits"), F.round(F.col("tokens") / (F.col("containers") * cap), 6).alias("filled"))
