"""Streaming jobs, run to the end of what has arrived, and the batch forms of the alerts."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.scd import VERSION_COLUMNS
from marquee.session import scratch_path
from marquee.sources import files
from marquee.streaming import jobs
from marquee.suite.core import query
from marquee.suite.scd import ATTRS, HISTORY_SQL, T1, T2, loads, moment

RAW_EVENTS = T.StructType([T.StructField(c, T.StringType()) for c in ("event_id", "user_id", "event_type")])


def event_stream(s):
    """The events table as a stream."""
    schema = s.events.schema
    return s.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{s.sf_dir}/events.parquet*")


@query("s01_stream_ingest", """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, 'events' AS _source_table FROM events""")
def s01(s):
    """Four files arrive, are taken in, then the last four; a third run finds nothing new."""
    raw, out, ckpt = (scratch_path(s.spark, n) for n in ("raw", "bronze", "ckpt"))
    text = s.events.select(*[F.col(c).cast("string") for c in RAW_EVENTS.names])
    stamp = F.lit(T1).cast("timestamp_ntz")
    for part, keep in (("a", "event_type IN ('error', 'click')"), ("b", "event_type NOT IN ('error', 'click')"), (None, None)):
        if part:
            files.write_raw_tsv(text.filter(keep).repartition(4), f"{raw}/{part}")
        jobs.stream_ingest(s.spark, f"{raw}/*", RAW_EVENTS, out, ckpt, "events", stamp, files_per_batch=2)
    return s.spark.read.parquet(out).select(*RAW_EVENTS.names, "_source_table")


@query("s02_stream_upsert", """
SELECT user_id, event_type, value, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1""")
def s02(s):
    """Latest event of each user."""
    target, ckpt = scratch_path(s.spark, "latest"), scratch_path(s.spark, "ckpt")
    stream = event_stream(s).select("user_id", "event_type", "value", "ts", "event_id")
    jobs.stream_upsert(stream, target, ["user_id"], "ts", ckpt)
    return jobs.read_upserted(s.spark, target, ["user_id"], "ts")


RATIO = """(SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS events, {avg} AS ratio, {avg} > {limit} AS firing FROM events GROUP BY 1)"""
ERROR_AVG = "avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)"


@query("s03_windowed_ratio", f"SELECT window_start, events, round(ratio, 8) AS ratio, firing FROM {RATIO.format(avg=ERROR_AVG, limit=0.01)}")
def s03(s):
    found = jobs.windowed_ratio(s.events, F.col("event_type") == "error", "5 minutes", 0.01)
    return found.withColumn("ratio", F.round("ratio", 8))


def run_to_table(s, df):
    """Run a stream to its end, appending to a new table, and return the table's path."""
    out, ckpt = scratch_path(s.spark, "stream-out"), scratch_path(s.spark, "ckpt")
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return out


@query("s03_windowed_ratio_stream", f"""
SELECT window_start, events, round(ratio, 8) AS ratio, firing FROM {RATIO.format(avg=ERROR_AVG, limit=0.01)}
WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def s03_stream(s):
    """The same as a stream; windows behind the watermark are final."""
    events = jobs.as_event_time(event_stream(s), "ts")
    found = jobs.windowed_ratio(events, F.col("event_type") == "error", "5 minutes", 0.01)
    rows = s.spark.read.schema(found.schema).parquet(run_to_table(s, found))
    return rows.withColumns({"ratio": F.round("ratio", 8), "window_start": F.col("window_start").cast("timestamp_ntz")})


@query("s04_windowed_percentile", """
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, round(quantile_cont(value, 0.95), 6) AS value, quantile_cont(value, 0.95) > 100 AS firing
FROM events GROUP BY 1""")
def s04(s):
    return jobs.windowed_percentile(s.events, "value", 0.95, "5 minutes", 100.0).withColumn("value", F.round("value", 6))


@query("s04_merged_sketches_stream", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS events, TRUE AS near FROM events
WHERE time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1""")
def s04_merged(s):
    """Hourly 95th percentiles merged from the stream's five-minute sketches; ``near``: the true rank is within 1% of the events, one at least."""
    events = jobs.as_event_time(event_stream(s), "ts")
    stored = s.spark.read.parquet(run_to_table(s, jobs.windowed_sketches(events, "value", "5 minutes")))
    found = jobs.merged_percentile(stored, 0.95, "1 hour", 100.0)
    closed = stored.select(F.col("window_start").alias("_closed"))
    truth = jobs.as_event_time(s.events, "ts").select("ts", F.col("value").alias("_v")).withColumn("_closed", F.window("ts", "5 minutes")["start"])
    truth = truth.join(closed, "_closed", "left_semi").withColumn("window_start", F.window("ts", "1 hour")["start"])
    ranks = truth.join(found, "window_start").groupBy("window_start", "events").agg(
        F.count_if(F.col("_v") < F.col("value")).alias("below"), F.count_if(F.col("_v") <= F.col("value")).alias("upto"))
    slack, place = F.greatest(F.lit(1.0), 0.01 * F.col("events")), 0.95 * F.col("events")
    near = (F.col("below") <= place + slack) & (F.col("upto") >= place - slack)
    return ranks.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "events", near.alias("near"))


@query("s05_staleness", """
SELECT round(date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01 00:00:00') / 3.6e9, 6) AS age_hours,
  date_diff('microsecond', max(ts), TIMESTAMP '2024-02-01 00:00:00') / 3.6e9 > 24 AS firing FROM events""")
def s05(s):
    found = jobs.staleness(s.events, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 24)
    return found.withColumn("age_hours", F.round("age_hours", 6))


MISS_AVG = "avg(CASE WHEN event_type <> 'view' THEN 1.0 ELSE 0.0 END)"


@query("s06_miss_ratio", f"SELECT window_start, events, round(ratio, 8) AS ratio, firing FROM {RATIO.format(avg=MISS_AVG, limit=0.5)}")
def s06(s):
    """Misses: everything but views."""
    found = jobs.windowed_ratio(s.events, F.col("event_type") != "view", "5 minutes", 0.5)
    return found.withColumn("ratio", F.round("ratio", 8))


@query("s07_held", f"""
WITH f AS (SELECT window_start FROM {RATIO.format(avg=MISS_AVG, limit=0.5)} WHERE firing),
i AS (SELECT window_start, window_start - INTERVAL 5 MINUTE * row_number() OVER (ORDER BY window_start) AS island FROM f),
p AS (SELECT window_start, row_number() OVER (PARTITION BY island ORDER BY window_start) AS n FROM i)
SELECT window_start FROM p WHERE n >= 3""")
def s07(s):
    windows = jobs.windowed_ratio(s.events, F.col("event_type") != "view", "5 minutes", 0.5)
    return jobs.held(windows, 3, 5)


@query("s07_held_stream", f"""
WITH f AS (SELECT window_start FROM {RATIO.format(avg=MISS_AVG, limit=0.5)} WHERE firing AND
  window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE),
i AS (SELECT window_start, window_start - INTERVAL 5 MINUTE * row_number() OVER (ORDER BY window_start) AS island FROM f),
p AS (SELECT window_start, row_number() OVER (PARTITION BY island ORDER BY window_start) AS n FROM i)
SELECT 'miss_ratio' AS rule, window_start FROM p WHERE n >= 3""")
def s07_stream(s):
    events = jobs.as_event_time(event_stream(s), "ts")
    windows = jobs.windowed_ratio(events, F.col("event_type") != "view", "5 minutes", 0.5).withColumn("rule", F.lit("miss_ratio"))
    windows = windows.select("rule", "window_start", "firing")
    follow = s.spark.readStream.schema(windows.schema).parquet(run_to_table(s, windows))
    alerts = jobs.held_stream(follow, 3, 5, "rule")
    rows = s.spark.read.schema(alerts.schema).parquet(run_to_table(s, alerts))
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("s07_held_changes_stream", f"""
WITH w AS (SELECT window_start, firing FROM {RATIO.format(avg=MISS_AVG, limit=0.5)}
  WHERE window_start + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE),
i AS (SELECT window_start, window_start - INTERVAL 5 MINUTE * row_number() OVER (ORDER BY window_start) AS island FROM w WHERE firing),
p AS (SELECT min(window_start) AS a, max(window_start) AS b FROM i GROUP BY island HAVING count(*) >= 3)
SELECT 'miss_ratio' AS rule, 'held' AS change, a + INTERVAL 10 MINUTE AS "at" FROM p
UNION ALL SELECT 'miss_ratio', 'ended', b + INTERVAL 5 MINUTE FROM p WHERE b < (SELECT max(window_start) FROM w)""")
def s07_changes(s):
    """When the alert comes on and goes off, also where windows are missing."""
    events = jobs.as_event_time(event_stream(s), "ts")
    windows = jobs.windowed_ratio(events, F.col("event_type") != "view", "5 minutes", 0.5).withColumn("rule", F.lit("miss_ratio"))
    windows = windows.select("rule", "window_start", "firing")
    follow = s.spark.readStream.schema(windows.schema).parquet(run_to_table(s, windows))
    with jobs.timer_state(s.spark):
        changes = jobs.held_changes(follow, 3, 5, "rule")
        rows = s.spark.read.schema(changes.schema).parquet(run_to_table(s, changes))
    return rows.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("s08_rate_violations", """
SELECT user_id, ts, requests FROM (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7200 SECOND PRECEDING AND CURRENT ROW) AS requests
  FROM events) WHERE requests > 2 GROUP BY ALL""")
def s08(s):
    return jobs.rate_violations(s.events, "user_id", "ts", n=2, seconds=7200)


STREAMED_SQL = f"""
WITH {HISTORY_SQL} SELECT c_custkey, c_name, c_nationkey, c_mktsegment, valid_from, valid_to, is_current,
  strftime(valid_from, 'load-%Y%m%d%H%M%S') AS batch_id, attr_hash FROM h"""


def streamed_history(s, *runs):
    """History after runs in which the numbered loads have arrived, each run a new start of the stream."""
    source, target, ckpt = (scratch_path(s.spark, n) for n in ("loads", "history", "ckpt"))
    arrivals = [df.withColumn("loaded_at", moment(t)) for df, t in zip(loads(s), (T1, T2))]
    for run in runs:
        for i in run:
            arrivals[i].write.parquet(f"{source}/{i}")
        stream = s.spark.readStream.schema(arrivals[0].schema).parquet(f"{source}/*")
        jobs.stream_scd2(stream, target, "c_custkey", ATTRS, "loaded_at", ckpt)
    return jobs.read_scd2(s.spark, target, "c_custkey").select("c_custkey", *ATTRS, *VERSION_COLUMNS)


@query("s09_stream_scd2", STREAMED_SQL)
def s09(s):
    """Two loads arrive one after the other; a third run finds nothing and changes nothing."""
    return streamed_history(s, [0], [1], [])


@query("s09_stream_scd2_one_batch", STREAMED_SQL)
def s09_one_batch(s):
    """Both loads wait in the source and share a micro-batch."""
    return streamed_history(s, [0, 1])


@query("s09_stream_scd2_late_load", STREAMED_SQL)
def s09_late(s):
    """The older load arrives after the newer one."""
    return streamed_history(s, [1], [0])
