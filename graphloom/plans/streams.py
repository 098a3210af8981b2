"""Queries that let the events table arrive as a stream, slice by slice; their twins are batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import diff
from graphloom.plans.registry import query
from graphloom.sources import star
from graphloom.streaming import events as ev


@query("l1_stream_manifest", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id", graph=False)
def l1_stream_manifest(spark, d):
    """Batches of a stream appended to a manifest of events by user."""
    rows = ev.replayed(star.table(spark, d, "events"), lambda s: s.select("user_id", "event_id"), "manifest")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"))


@query("l1_stream_units", """
WITH b AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events), e AS (SELECT user_id, event_type, ts, event_id, least(3, floor((epoch_us(ts) - low) * 4 / greatest(1, high - low))) AS k FROM events, b)
, m AS (SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE k < 3) AS old, arg_max(event_type, (ts, event_id)) AS new FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN old IS NULL THEN 'SYMBOL_ADDED' ELSE 'KIND_CHANGED' END AS unit FROM m WHERE old IS DISTINCT FROM new""", graph=False)
def l1_stream_units(spark, d):
    """Delta units of the last batch: the manifest of all batches against that of those before the last."""
    e = star.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = ev.slices(e)
    by = lambda rows: rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    before, after = parts[0], ev.replayed(e, lambda s: s.select("user_id", "event_type", "ts", "event_id"), "units")
    for part in parts[1:-1]:
        before = before.unionByName(part)
    return diff.delta_units(by(before), by(after), "user_id", {"KIND_CHANGED": "kind"})


@query("l2_stream_lineage", """
SELECT run, object, writer, event_id AS reader FROM (
  SELECT *, last_value(CASE WHEN op IN ('WRITE', 'READ_WRITE') THEN event_id END IGNORE NULLS) OVER (PARTITION BY run, object ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer FROM data_events)
WHERE op IN ('READ', 'READ_WRITE') AND writer IS NOT NULL""")
def l2_stream_lineage(spark, d):
    events = star.data_events(spark, d).select("run", "object", "event_id", "ts", "op")
    # keys are nearly as many as events, and a state that Python visits key by key takes a call for each
    return ev.replayed(events, lambda s: s, "lineage", step=ev.lineage_of_batches(spark), schema="run long, object string, writer long, reader long")


@query("l3_window_counts", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL", graph=False)
def l3_window_counts(spark, d):
    rows = ev.replayed(star.table(spark, d, "events"), lambda s: ev.counts_by_window(s, "6 hours"), "windows", "complete")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("l3_sliding_counts", """
SELECT time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL (3 * k) HOUR AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL""", graph=False)
def l3_sliding_counts(spark, d):
    rows = ev.replayed(star.table(spark, d, "events"), lambda s: ev.counts_by_window(s, "6 hours", "3 hours"), "windows", "complete")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("l4_stream_sessions", """
, g AS (SELECT run, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS f FROM data_events WINDOW w AS (PARTITION BY run ORDER BY ts, event_id))
, s AS (SELECT run, ts, sum(f) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT run, min(ts) AS start, count(*) AS n FROM s GROUP BY run, k""")
def l4_stream_sessions(spark, d):
    rows = ev.replayed(star.data_events(spark, d).select("run", "ts"), lambda s: ev.session_counts(s, "2 hours"), "sessions", "complete")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("l5_first_claims", "SELECT DISTINCT user_id, event_type FROM events", graph=False)
def l5_first_claims(spark, d):
    rows = ev.replayed(star.table(spark, d, "events"), lambda s: ev.first_claims(s, ["user_id", "event_type"]), "claims")
    return rows.select("user_id", "event_type")


#: The events by slice of time (k) and of arrival (a: errors come one slice late), with the watermark of an hour
#: behind all that came in earlier slices.
_LATE = """
WITH b AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events)
, e AS (SELECT *, least(3, floor((epoch_us(ts) - low) * 4 / greatest(1, high - low)))::INTEGER AS k, json_extract_string(props, '$.k') AS object FROM events, b)
, arrived AS (SELECT *, k + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS a FROM e)
, mark AS (SELECT s.a, (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 1 HOUR FROM arrived x WHERE x.a < s.a) AS w FROM (SELECT unnest(range(5)) AS a) s)
"""

_UNITS = """
, by_slice AS (SELECT user_id || '/' || left(object, 1) AS file, k, arg_max(event_type, (ts, event_id)) AS kind, max(ts) AS ts FROM e GROUP BY ALL)
, timeline AS (SELECT s.k, (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 1 HOUR FROM e x WHERE x.k < s.k) AS w FROM (SELECT unnest(range(4)) AS k) s)
, seq AS (SELECT b.*, lag(kind) OVER v AS old, date_trunc('millisecond', lag(ts) OVER v) + INTERVAL 7 DAY < w AS gone, lead(file) OVER v IS NULL AS last FROM by_slice b JOIN timeline USING (k) WINDOW v AS (PARTITION BY file ORDER BY k))
SELECT file, CASE WHEN old IS NULL OR gone THEN 'SYMBOL_ADDED' ELSE 'KIND_CHANGED' END AS unit, kind FROM seq WHERE old IS NULL OR gone OR old <> kind
UNION ALL SELECT file, 'SYMBOL_REMOVED', old FROM seq WHERE gone UNION ALL SELECT file, 'SYMBOL_REMOVED', kind FROM seq WHERE last"""


@query("l1_keyed_units", _LATE + _UNITS, graph=False)
def l1_keyed_units(spark, d):
    """The manifest as a table of last kinds, batch by batch: what is added, changed, and removed after a week without an event."""
    file = F.concat_ws("/", F.col("user_id").cast("string"), F.substring(F.get_json_object("props", "$.k"), 1, 1))
    events = star.table(spark, d, "events").select(file.alias("file"), F.col("event_type").alias("kind"), "ts", "event_id")
    return ev.replayed(events, lambda s: s, "units", close=True, step=ev.units_of_batches(spark, "7 days"), schema="file string, unit string, kind string")


@query("l3_late_windows", f"""{_LATE}
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n FROM arrived JOIN mark USING (a) WHERE w IS NULL OR time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR > w GROUP BY ALL""", graph=False)
def l3_late_windows(spark, d):
    """Counts that are written once, when their window is closed; errors come late and what is too late is dropped."""
    late = F.when(F.col("event_type") == "error", 1).otherwise(0)
    rows = ev.replayed(star.table(spark, d, "events"), lambda s: ev.counts_by_window(s, "6 hours"), "windows", late=late, most=1, close=True)
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("l4_closed_sessions", """
, g AS (SELECT run, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 7200000000 THEN 0 ELSE 1 END AS f FROM data_events WINDOW w AS (PARTITION BY run ORDER BY ts, event_id))
, s AS (SELECT run, ts, sum(f) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT run, min(ts) AS start, count(*) AS n FROM s GROUP BY run, k""")
def l4_closed_sessions(spark, d):
    """Sessions that are written once, when the watermark has passed them; their state goes with that."""
    rows = ev.replayed(star.data_events(spark, d).select("run", "ts"), lambda s: ev.session_counts(s, "2 hours"), "sessions", close=True)
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("l2_batched_lineage", """
SELECT run, object, writer, event_id AS reader FROM (
  SELECT *, last_value(CASE WHEN op IN ('WRITE', 'READ_WRITE') THEN event_id END IGNORE NULLS) OVER (PARTITION BY run, object ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS writer FROM data_events)
WHERE op IN ('READ', 'READ_WRITE') AND writer IS NOT NULL""")
def l2_batched_lineage(spark, d):
    """Lineage batch by batch over a table of last writes, with no key in one frame."""
    events = star.data_events(spark, d).select("run", "object", "event_id", "ts", "op")
    return ev.replayed(events, lambda s: s, "lineage", step=ev.lineage_of_batches(spark), schema="run long, object string, writer long, reader long")
