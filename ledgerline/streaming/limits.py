"""Sliding limits and windows over events, in batch and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window


class SlidingLog:
    """Times of admitted events within the window; at most ``limit`` are ever held."""

    def __init__(self, seconds: float, limit: int, times: list[float] | None = None) -> None:
        self.seconds, self.limit, self.times = seconds, limit, deque(times or [])

    def check(self, now: float) -> tuple[bool, int]:
        """(admitted, seconds to wait). A limit of 0 or less admits everything."""
        if self.limit <= 0:
            return True, 0
        while self.times and now - self.times[0] >= self.seconds:
            self.times.popleft()
        if len(self.times) < self.limit:
            self.times.append(now)
            return True, 0
        return False, max(1, int(self.seconds - (now - self.times[0])) + 1)


def rate_limit(events: DataFrame, key: str, time: str, ident: str, seconds: float, limit: int) -> DataFrame:
    """(ident, key, admitted, retry_after) of every event, each key's events taken in time order.

    Keys are hash-partitioned and sorted; a task streams through its rows with one key's log as its
    only state, so a hot key is never gathered. Events without key or time are left out; ties go by id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, log = None, SlidingLog(seconds, limit)
        for b in batches:
            out = []
            for k, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if k != held:
                    held, log = k, SlidingLog(seconds, limit)
                out.append(log.check(t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in out], pa.bool_()), pa.array([x[1] for x in out], pa.int64())], names=[ident, key, "admitted", "retry_after"])

    kinds = dict(events.dtypes)
    rows = events.select(ident, key, (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("__t")).filter(F.col(key).isNotNull() & F.col("__t").isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, "__t", ident).mapInArrow(run, f"{ident} {kinds[ident]}, {key} {kinds[key]}, admitted boolean, retry_after long")


def rate_limit_stream(events: DataFrame, key: str, time: str, ident: str, seconds: float, limit: int) -> DataFrame:
    """The same limiter as a stateful stream: the log of admitted times is the state of a key.

    Rows of a micro-batch are taken in time order; an event that arrives in a later batch is judged against
    what was admitted before it arrived. State is dropped when a key is idle for the window's length.
    """
    kinds = dict(events.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = SlidingLog(seconds, limit, list(state.get[0]) if state.exists else None)
        rows = pd.concat(list(frames)).sort_values(["t", ident])
        seen = [log.check(t) for t in rows["t"]]
        state.update((list(log.times),))
        state.setTimeoutDuration(int(seconds * 1000))
        yield pd.DataFrame({ident: rows[ident], key: [k[0]] * len(rows), "admitted": [x[0] for x in seen], "retry_after": [x[1] for x in seen]})

    rows = events.select(ident, key, (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{ident} {kinds[ident]}, {key} {kinds[key]}, admitted boolean, retry_after long", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def budget_use(events: DataFrame, key: str, time: str, amount: str, seconds: int) -> DataFrame:
    """Each event with the number and amount of its key's events in the window that ends with it."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(t).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("used", F.count(F.lit(1)).over(w)).withColumn("spent", F.sum(amount).over(w))


def merged_limits(learned: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Stored limits with the non-null learned ones in their place."""
    cols = [c for c in stored.columns if c != key]
    a, b = learned.alias("a"), stored.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in cols])


def tumbling(events: DataFrame, time: str, length: str, key: list[str], amount: str, late: str | None = None) -> DataFrame:
    """Counts and sums per window; ``late`` is the watermark of a stream."""
    df = events.withColumn("__t", F.col(time).cast("timestamp"))
    df = df.withWatermark("__t", late) if late else df
    g = df.groupBy(F.window("__t", length).alias("w"), *key).agg(F.count(F.lit(1)).alias("n"), F.sum(amount).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *key, "n", "total")


def sessions(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, session_start, session_end, n): runs of a key's events with no gap of ``gap`` or more."""
    df = events.withColumn("__t", F.col(time).cast("timestamp"))
    g = df.groupBy(F.session_window("__t", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def index_stream(chunks: DataFrame, path: str, checkpoint: str, ident: str, collection: str):  # noqa: ANN201
    """Start an indexer that appends each micro-batch's new chunks by collection; finished batches are never redone.

    A chunk is new if neither the batch holds it twice nor the stored collections of the batch hold its id;
    other collections are not read.
    """

    def store(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([collection, ident])
        try:
            stored = batch.sparkSession.read.parquet(path).select(F.col(collection).cast(dict(batch.dtypes)[collection]).alias(collection), ident)
        except AnalysisException:
            stored = None
        if stored is not None:
            touched = fresh.select(collection).distinct()
            fresh = fresh.join(stored.join(touched, collection, "left_semi"), [collection, ident], "left_anti")
        fresh.write.mode("append").partitionBy(collection).parquet(path)

    return chunks.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def order_for_role(candidates: DataFrame, requires: list[str]) -> DataFrame:
    """Candidates (name, rank, caps) that have all required capabilities, with their ``position`` by rank and name."""
    lacking = F.array_except(F.array(*[F.lit(r) for r in requires]).cast("array<string>"), F.coalesce("caps", F.array().cast("array<string>")))
    return candidates.filter(F.size(lacking) == 0).withColumn("position", F.row_number().over(Window.orderBy("rank", "name")))  # a list of models


#: Outcomes after which the same candidate is asked again; others pass to the next one.
RETRIED = ("rate_limited", "timeout")


def failover(calls: DataFrame, request: str, attempts: int = 3) -> DataFrame:
    """(request, candidate, tries, outcome): who answers a request, after how many calls.

    ``calls`` hold request, position of the candidate, candidate, attempt and outcome. Candidates are asked by
    position; after an outcome of ``RETRIED`` the same one again, up to ``attempts`` times, after any
    other failure the next. The first ``ok`` answers; without one the last outcome stands.
    """
    own = Window.partitionBy(request, "position").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.max(F.when(~F.col("outcome").isin(*RETRIED), 1).otherwise(0)).over(own)
    made = calls.filter(F.col("attempt") <= attempts).withColumn("__gone", F.coalesce(gone, F.lit(0))).filter("__gone = 0")
    first = Window.partitionBy(request).orderBy("position", "attempt").rowsBetween(Window.unboundedPreceding, -1)
    asked = made.withColumn("__ok", F.coalesce(F.max(F.when(F.col("outcome") == "ok", 1).otherwise(0)).over(first), F.lit(0))).filter("__ok = 0")
    last = asked.groupBy(request).agg(F.count(F.lit(1)).alias("tries"), F.max_by(F.struct("candidate", "outcome"), F.struct("position", "attempt")).alias("l"))
    return last.select(request, "l.candidate", "tries", "l.outcome")


def write_in_phases(chunks: DataFrame, first: str, path: str) -> None:
    """Append the chunks marked ``first`` and then all others: a reader may start after the first write."""
    kept = F.coalesce(F.col(first), F.lit(False))
    chunks.filter(kept).drop(first).write.mode("append").parquet(path)
    chunks.filter(~kept).drop(first).write.mode("append").parquet(path)
