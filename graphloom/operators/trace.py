"""Windows over runs: lineage, numbering, nesting, samples, rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import settled


def last_writer(events: DataFrame, order: Sequence[str], writes: Sequence[str] = ("WRITE", "READ_WRITE"), reads: Sequence[str] = ("READ", "READ_WRITE")) -> DataFrame:
    """run, object, writer, reader: each read with the latest earlier write of the same object."""
    w = Window.partitionBy("run", "object").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    writer = F.last(F.when(F.col("op").isin(*writes), F.col("event_id")), ignorenulls=True).over(w)
    rows = events.withColumn("writer", writer).where(F.col("op").isin(*reads) & F.col("writer").isNotNull())
    return rows.select("run", "object", "writer", F.col("event_id").alias("reader"))


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "seq") -> DataFrame:
    """Rows with a dense number from 0 in each key."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def numbered_everywhere(rows: DataFrame, order: Sequence[str], name: str = "seq") -> DataFrame:
    """Rows with a dense number from 0 over all of them: ranges are sorted apart, and each begins where those before it end."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settled(placed.select("*", F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at_")), "numbered")
    size = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    before = size.withColumn("before_", F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).select("part_", "before_")
    # one row a range
    return placed.join(F.broadcast(before), "part_").withColumn(name, F.col("before_") + F.col("at_")).drop("part_", "at_", "before_")


def clusters(rows: DataFrame, keys: Sequence[str], order: Sequence[str], opens: Column) -> DataFrame:
    """Rows with the number of the cluster they stand in: opening rows begin a new one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("cluster", F.sum(opens.cast("long")).over(w))


def nesting(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Enter (+1) and exit (-1) rows with depth, and for enters the order of the enclosing frame.

    rows: keys, order, step. The parent of an enter at depth d is the last enter at depth d - 1
    before it, found by a window over (keys, level) on rows that stand at both levels.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    deep = rows.withColumn("run_", F.sum("step").over(w)).withColumn("depth", F.when(F.col("step") > 0, F.col("run_")).otherwise(F.col("run_") + 1))
    enters = deep.where("step > 0")
    both = enters.select(*keys, order, "depth", F.explode(F.array(F.col("depth"), F.col("depth") - 1)).alias("level"))
    by_level = Window.partitionBy(*keys, "level").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parent = F.last(F.when(F.col("depth") == F.col("level"), F.col(order)), ignorenulls=True).over(by_level)
    found = both.withColumn("parent", parent).where("level = depth - 1").select(*keys, order, "parent")
    return deep.drop("run_").join(found, [*keys, order], "left")


def sample(rows: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group, the same at every run: those with the least hash of their key."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key)
    return rows.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= n).drop("rn_")


def rankings(rows: DataFrame, key: str, measures: Sequence[str], most: int) -> DataFrame:
    """measure, rank, key, value: the top rows by each measure, apart from each other."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    long = rows.select(key, F.explode(pairs).alias("m")).select("m.measure", "m.value", key)
    w = Window.partitionBy("measure").orderBy(F.desc("value"), key)
    return long.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= most).select("measure", "rank", key, "value")


def sessions(events: DataFrame, keys: Sequence[str], time: str, gap_seconds: int) -> DataFrame:
    """Events with a session number: a new one after a pause longer than the gap."""
    w = Window.partitionBy(*keys).orderBy(time, "event_id")
    pause = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    fresh = events.withColumn("new_", F.coalesce((pause > gap_seconds * 1_000_000).cast("long"), F.lit(1)))
    return fresh.withColumn("session", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def payloads(rows: DataFrame, key: str, value: str, order: Sequence[str], keep: int) -> DataFrame:
    """key, low, high, nonzero, all_zero, and the first `keep` values in order, to two places."""
    w = Window.partitionBy(key).orderBy(*order)
    first = rows.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= keep)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k_", value))), lambda x: x[value].cast("decimal(18,2)").cast("string"))
    first = first.groupBy(key).agg(F.array_join(listed, ",").alias("first"))
    v = F.col(value)
    by = rows.groupBy(key).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(v != 0).alias("nonzero"), F.bool_and(v == 0).alias("all_zero"))
    return by.join(first, key)


def integrity(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """keys, integrity (exit_without_enter, unclosed_frames or ok), unclosed: whether enters (+1) and exits (-1) match."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    by = rows.withColumn("depth_", F.sum("step").over(w)).groupBy(*keys).agg(F.min("depth_").alias("low"), F.sum("step").alias("open"))
    state = F.when(F.col("low") < 0, "exit_without_enter").when(F.col("open") > 0, "unclosed_frames").otherwise("ok")
    return by.select(*keys, state.alias("integrity"), F.greatest(F.lit(0).cast("long"), "open").alias("unclosed"))


def _dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows in ranges of keys and order, with the number of their range (part_): a key of many rows fills several
    ranges, and all but the first and last key of a range are in that range alone."""
    placed = rows.repartitionByRange(*keys, *order)
    return settled(placed.withColumn("part_", F.spark_partition_id()), "dealt")


def _spanning(by_part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows (keys, part_, ...) of keys that fill several ranges: fewer than twice the ranges."""
    return by_part.withColumn("parts_", F.count("*").over(Window.partitionBy(*keys))).where("parts_ > 1").drop("parts_")


def numbered_dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "seq") -> DataFrame:
    """Rows with a dense number from 0 in each key, where one key may hold most rows: each range is numbered apart."""
    placed = _dealt(rows, keys, order)
    size = _spanning(placed.groupBy(*keys, "part_").agg(F.count("*").alias("n_")), keys)
    before = size.select(*keys, "part_", (F.sum("n_").over(Window.partitionBy(*keys).orderBy("part_")) - F.col("n_")).alias("before_"))
    local = F.row_number().over(Window.partitionBy(*keys, "part_").orderBy(*order)) - 1
    # few rows a range
    out = placed.withColumn("at_", local).join(F.broadcast(before), [*keys, "part_"], "left")
    return out.withColumn(name, (F.col("at_") + F.coalesce("before_", F.lit(0))).cast("long")).drop("at_", "before_", "part_")


def lagged_dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows with the value of the row before in their key, where one key may hold most rows."""
    placed = _dealt(rows, keys, order)
    w = Window.partitionBy(*keys, "part_").orderBy(*order)
    ends = _spanning(placed.groupBy(*keys, "part_").agg(F.max_by(value, F.struct(*order)).alias("end_")), keys)
    before = ends.select(*keys, "part_", F.lag("end_").over(Window.partitionBy(*keys).orderBy("part_")).alias("carried_"))
    out = placed.withColumns({name: F.lag(value).over(w), "first_": F.row_number().over(w) == 1}).join(F.broadcast(before), [*keys, "part_"], "left")
    return out.withColumn(name, F.when(F.col("first_"), F.col("carried_")).otherwise(F.col(name))).drop("first_", "carried_", "part_")


def frames(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Enter (step 1) and exit (step -1) rows with level, the frame that they open or close, and empty: an exit without
    an open frame, which closes none.

    The level is a running sum that never falls below 0: the sum less the least sum so far. Ranges of a long
    run are summed up apart, with the sums and least sums of the ranges before them.
    """
    placed = _dealt(rows, keys, order)
    w = Window.partitionBy(*keys, "part_").orderBy(*order)
    so_far, before_it = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("s_", F.sum("step").over(so_far))
    summed = summed.withColumns({"low_": F.min("s_").over(so_far), "low_before_": F.min("s_").over(before_it)})
    parts = _spanning(summed.groupBy(*keys, "part_").agg(F.sum("step").alias("t_"), F.min("s_").alias("l_")), keys)
    by = Window.partitionBy(*keys).orderBy("part_")
    parts = parts.withColumn("base_", F.sum("t_").over(by) - F.col("t_"))
    parts = parts.select(*keys, "part_", "base_", F.min(F.col("base_") + F.col("l_")).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("least_"))
    out = summed.join(F.broadcast(parts), [*keys, "part_"], "left")
    base, none = F.coalesce("base_", F.lit(0)), F.lit(0).cast("long")
    least = lambda c: F.least(none, F.coalesce("least_", none), F.coalesce(base + F.col(c), none))
    depth = base + F.col("s_") - least("low_")
    empty = (F.col("step") < 0) & (base + F.col("s_") < least("low_before_"))
    level = F.when(F.col("step") > 0, depth).when(~empty, depth + 1)
    return out.select(*rows.columns, level.cast("long").alias("level"), empty.alias("empty"))


def trace_errors(rows: DataFrame, keys: Sequence[str], order: Sequence[str], known: DataFrame, markers: DataFrame) -> DataFrame:
    """keys, status (COMPLETE or PARTIAL), errors (sorted, joined by commas), enters, exits of each run.

    rows: keys, order, step (1 or -1), site; known: site; markers: keys, enters, exits, failed (the run's END).
    An exit must close the frame of its own site: enters and exits of a level alternate, so the row before it
    on its level opened what it closes.
    """
    placed = settled(frames(rows, keys, order), "frames")
    paired = lagged_dealt(placed.where("level IS NOT NULL"), [*keys, "level"], order, "site", "opened")
    wrong = paired.where("step < 0").groupBy(*keys).agg(F.count_if(~F.col("opened").eqNullSafe(F.col("site"))).alias("wrong"))
    lost = placed.select(*keys, "site").distinct().join(known.select("site").distinct(), "site", "left_anti").select(*keys).distinct().withColumn("unmapped", F.lit(True))
    by = placed.groupBy(*keys).agg(F.count_if(F.col("step") > 0).alias("enters"), F.count_if(F.col("step") < 0).alias("exits"), F.count_if("empty").alias("empty"))
    end = markers.select(*keys, F.col("enters").alias("marked_in"), F.col("exits").alias("marked_out"), "failed", F.lit(True).alias("marked"))
    j = by.join(wrong, list(keys), "left").join(lost, list(keys), "left").join(end, list(keys), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    cases = [
        (~yes("marked"), "end_marker_malformed"), (~yes("marked"), "end_marker_missing"), (F.col("enters") != F.col("exits"), "enter_exit_count_mismatch"),
        (yes("marked") & ((F.col("marked_in") != F.col("enters")) | (F.col("marked_out") != F.col("exits"))), "event_count_mismatch"),
        ((F.coalesce("wrong", F.lit(0)) > 0) | (F.col("empty") > 0), "exit_stack_mismatch"), (yes("marked") & (F.col("failed") > 0), "trace_write_failure"),
        (F.col("enters") > F.col("exits") - F.col("empty"), "unclosed_frames"), (yes("unmapped"), "unmapped_function_offset"),
    ]
    errors = F.array_join(F.array_compact(F.array(*[F.when(c, code) for c, code in cases])), ",")
    return j.select(*keys, F.when(errors == "", "COMPLETE").otherwise("PARTIAL").alias("status"), errors.alias("errors"), "enters", "exits")


def carried_dealt(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Rows with the last value before them in their key that is not null, where one key may hold most rows."""
    placed = _dealt(rows, keys, order)
    before_it = Window.partitionBy(*keys, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = _spanning(placed.groupBy(*keys, "part_").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("end_")), keys)
    by = Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "part_", F.last("end_", ignorenulls=True).over(by).alias("carried_"))
    # few rows a range
    out = placed.withColumn(name, F.last(value, ignorenulls=True).over(before_it)).join(F.broadcast(ends), [*keys, "part_"], "left")
    return out.withColumn(name, F.coalesce(name, "carried_")).drop("carried_", "part_")
