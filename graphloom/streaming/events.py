"""Streams of data events: windowed counts, first claims, sessions, and last-writer lineage with state.

Each function takes a streaming (or batch) DataFrame; `replayed` lets a table arrive slice by slice
and returns the rows that the stream wrote. State is kept as long as the watermark says, so the
delays below are parameters of what a stream may still see, not of how long it runs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphloom.functions import shared_path
from graphloom.operators.trace import carried_dealt


def slices(events: DataFrame, n: int = 4, late: Column | None = None, most: int = 0) -> list[DataFrame]:
    """The events cut into n parts by time, one after the other. late: how many parts later a row comes, up to `most`,
    which is as many parts more."""
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    if low is None:
        return [events]
    part = F.least(F.lit(n - 1), F.floor((F.unix_micros("ts") - low) * n / max(1, high - low)))
    if late is not None:
        part = part + F.least(late, F.lit(most))
    return [events.where(part == k) for k in range(n + most)]


def closing(events: DataFrame, after: str = "730 days") -> DataFrame:
    """One row long after all events, null but for its time: it lets the watermark pass whatever is open."""
    end = events.agg((F.max("ts") + F.expr(f"INTERVAL {after}")).alias("ts")).where("ts IS NOT NULL")
    return end.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema])


def counts_by_window(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, event_type, n of each tumbling or sliding window."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    by = events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"))
    return by.select(F.col("window.start").alias("start"), "event_type", "n")


def first_claims(events: DataFrame, keys: list[str], late: str = "365 days") -> DataFrame:
    """The first event of each key; a key is forgotten once the watermark has passed it by `late`."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def session_counts(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """run, start, n of each session: events of a run without a longer pause than the gap."""
    by = events.withWatermark("ts", late).groupBy("run", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return by.select("run", F.col("session_window.start").alias("start"), "n")


def lineage(events: DataFrame, late: str = "1 hour", forget_ms: int = 365 * 86_400_000) -> DataFrame:
    """run, object, writer, reader by state: the last write of each (run, object).

    events: run, object, event_id, ts, op. Within a batch the events of a key are sorted by
    (ts, event_id); events later than the watermark are left out by Spark, so no batch writes before
    what an earlier one has read. The last write is forgotten `forget_ms` behind the watermark.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        wrote = rows["event_id"].where(rows["op"].isin(["WRITE", "READ_WRITE"])).astype("Int64").ffill()
        before = wrote.shift()
        if last is not None:
            before = before.fillna(last)
        reads = rows["op"].isin(["READ", "READ_WRITE"]) & before.notna()
        if not wrote.empty and pd.notna(wrote.iloc[-1]):
            last = int(wrote.iloc[-1])
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["ts"].max().timestamp() * 1000)) + forget_ms)
        yield pd.DataFrame({"run": key[0], "object": key[1], "writer": before[reads].astype("int64"), "reader": rows["event_id"][reads]})

    keyed = events.withWatermark("ts", late).groupBy("run", "object")
    return keyed.applyInPandasWithState(step, "run long, object string, writer long, reader long", "last long", "append", "EventTimeTimeout")


def lineage_of_batches(spark: SparkSession, forget: str = "365 days") -> Callable[[DataFrame, int], DataFrame]:
    """A step for `replayed`: run, object, writer, reader of a batch, with the last writes of earlier batches.

    These are a table with a version a batch: batch n reads version n - 1 and writes version n, so a batch that
    is run again does the same. Writes that are older than `forget` behind the newest event of a batch are left
    out of its version. A key of many events is dealt over tasks.
    """
    root = shared_path(spark, "last-writes")
    kind = "run long, object string, event_id long, ts timestamp"

    def step(batch: DataFrame, n: int) -> DataFrame:
        old = spark.read.schema(kind).parquet(f"{root}/{n - 1}") if n else spark.createDataFrame([], kind)
        old = old.select("run", "object", "event_id", "ts", F.lit("WRITE").alias("op"), F.lit(0).alias("now"))
        rows = old.unionByName(batch.select("run", "object", "event_id", "ts", "op", F.lit(1).alias("now")))
        wrote = F.when(F.col("op").isin("WRITE", "READ_WRITE"), F.col("event_id"))
        rows = rows.withColumn("wrote", wrote)
        found = carried_dealt(rows, ["run", "object"], ["now", "ts", "event_id"], "wrote", "writer")
        kept = rows.where("wrote IS NOT NULL").groupBy("run", "object").agg(F.max_by(F.struct("event_id", "ts"), F.struct("now", "ts", "event_id")).alias("l")).select("run", "object", "l.event_id", "l.ts")
        newest = batch.agg(F.max("ts")).first()[0]
        if newest is not None:
            kept = kept.where(F.col("ts") >= F.lit(newest) - F.expr(f"INTERVAL {forget}"))
        kept.write.mode("overwrite").parquet(f"{root}/{n}")
        reads = (F.col("now") == 1) & F.col("op").isin("READ", "READ_WRITE") & F.col("writer").isNotNull()
        return found.where(reads).select("run", "object", "writer", F.col("event_id").alias("reader"))

    return step


class Manifest(StatefulProcessor):
    """The last kind of each file as keyed state, which emits what changed: SYMBOL_ADDED, KIND_CHANGED, and
    SYMBOL_REMOVED for a file that was not seen again for `forget_ms`, whose state ends with that."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "kind string, at long, event_id long")

    def _told(self, key: tuple, unit: str, kind: str) -> pd.DataFrame:
        return pd.DataFrame({"file": [key[0]], "unit": [unit], "kind": [kind]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        old = tuple(self.last.get()) if self.last.exists() else None
        new = old
        for part in rows:  # only the newest row of each part is held
            part = part[part["event_id"].notna()]
            if part.empty:  # a closing row only moves the watermark
                continue
            row = part.sort_values(["at", "event_id"]).iloc[-1]
            if new is None or (int(row["at"]), int(row["event_id"])) > (new[1], new[2]):
                new = (row["kind"], int(row["at"]), int(row["event_id"]))
        if new == old:
            return
        self.last.update(new)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(new[1] // 1000 + self.forget_ms)
        if old is None or old[0] != new[0]:
            yield self._told(key, "SYMBOL_ADDED" if old is None else "KIND_CHANGED", new[0])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        kind = self.last.get()[0]
        self.last.clear()
        yield self._told(key, "SYMBOL_REMOVED", kind)

    def close(self) -> None:
        pass


def delta_units(events: DataFrame, forget: str, late: str = "1 hour") -> DataFrame:
    """file, unit, kind: the changes of the manifest, as they come. events: file, kind, ts, event_id."""
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)
    keyed = events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late).groupBy("file")
    return keyed.transformWithStateInPandas(Manifest(forget_ms), "file string, unit string, kind string", "Append", "EventTime")


def units_of_batches(spark: SparkSession, forget: str, late: str = "1 hour") -> Callable[[DataFrame, int], DataFrame]:
    """A step for `replayed`: what `delta_units` tells, with the files' last kinds as a table with a version a batch in
    place of a state that Python visits key by key.

    events: file, kind, ts, event_id (null in a closing row). Batch n reads version n - 1 and writes version n, so a
    batch that is run again does the same. A file is gone once the newest event so far, less `late`, has passed its
    last one by `forget`; as in a stream, that is judged when a batch is done.
    """
    root = shared_path(spark, "last-kinds")
    kind = "file string, kind string, at long, event_id long, unit string, gone boolean"
    forget_ms, late_ms = (int(pd.Timedelta(x).total_seconds() * 1000) for x in (forget, late))

    def step(batch: DataFrame, n: int) -> DataFrame:
        old = spark.read.schema(kind).parquet(f"{root}/{n - 1}") if n else spark.createDataFrame([], kind)
        rows = batch.select("file", "kind", F.unix_micros("ts").alias("at"), "event_id")
        newest = max((x for x in (rows.agg(F.max("at")).first()[0], old.agg(F.max("at")).first()[0]) if x is not None), default=0)
        last = lambda name: F.max_by(F.struct("kind", "at", "event_id"), F.struct("at", "event_id")).alias(name)
        new = rows.where("event_id IS NOT NULL").groupBy("file").agg(last("b"))
        j = old.where("NOT gone").select("file", F.struct("kind", "at", "event_id").alias("a")).join(new, "file", "full_outer")
        fresh = F.col("b").isNotNull() & (F.col("a").isNull() | (F.struct("b.at", "b.event_id") > F.struct("a.at", "a.event_id")))
        unit = F.when(fresh & F.col("a").isNull(), "SYMBOL_ADDED").when(fresh & ~F.col("a.kind").eqNullSafe(F.col("b.kind")), "KIND_CHANGED")
        j = j.select("file", F.when(fresh, F.col("b")).otherwise(F.col("a")).alias("c"), unit.alias("unit")).select("file", "c.*", "unit")
        j.withColumn("gone", F.expr("at div 1000") + forget_ms < newest // 1000 - late_ms).write.mode("overwrite").parquet(f"{root}/{n}")
        done = spark.read.schema(kind).parquet(f"{root}/{n}")
        told = F.array_compact(F.array("unit", F.when(F.col("gone"), "SYMBOL_REMOVED")))
        return done.select("file", F.explode(told).alias("unit"), "kind")

    return step


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state with timers lives in RocksDB; the session's own choice comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def replayed(
    events: DataFrame, make: Callable[[DataFrame], DataFrame], name: str, mode: str = "append", n: int = 4,
    late: Column | None = None, most: int = 0, close: bool = False, keyed: bool = False, progress: list[dict] | None = None,
    step: Callable[[DataFrame, int], DataFrame] | None = None, schema: str | None = None,
) -> DataFrame:
    """Lets the events arrive in n slices by time, each a batch of its own of one query that is started anew
    from its checkpoint, and reads what it wrote. In complete mode every batch replaces the table.

    late and most: rows that come so many slices later than their time says; close: a last row long after the
    others, so that in append mode all windows are written; keyed: keyed state with timers; progress: gets
    Spark's account of each batch; step: makes rows of this schema of each batch and its number.
    """
    spark: SparkSession = events.sparkSession
    arrivals, out, marks = (shared_path(spark, f"{name}-{x}") for x in ("arrivals", "rows", "marks"))
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))

    def put(batch: DataFrame, n_batch: int) -> None:
        if step is not None:
            # a folder a batch: one that is run again replaces its rows
            step(batch, n_batch).write.mode("overwrite").parquet(f"{out}/batch={n_batch}")
            return
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    made = None
    with _keyed_state(spark) if keyed else nullcontext():
        for part in [*slices(events, n, late, most), *([closing(events)] if close else [])]:
            part.write.mode("append").parquet(arrivals)
            rows = make(spark.readStream.schema(events.schema).parquet(arrivals))
            made = rows.schema
            query = rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start()
            query.awaitTermination()
            if progress is not None:
                progress += [json.loads(p.json) for p in query.recentProgress]
    if schema is not None:
        return spark.read.schema(f"{schema}, batch int").parquet(out).drop("batch")
    return spark.read.schema(made).parquet(out)
