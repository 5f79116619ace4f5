"""Streaming jobs: files taken in once, replays, alerts and rate checks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from marquee.operators import scd
from marquee.session import scratch_path
from marquee.sources import files
from marquee.streaming import jobs


def test_each_file_is_taken_in_once(spark):
    raw, out, ckpt = (scratch_path(spark, n) for n in ("raw", "out", "ckpt"))
    schema = files.text_schema(["a", "b"])
    stamp = F.lit("2024-01-01").cast("timestamp_ntz")
    ingest = lambda: jobs.stream_ingest(spark, f"{raw}/*", schema, out, ckpt, "t", stamp, files_per_batch=1)
    for i in range(3):
        df = spark.createDataFrame([(f"x{i}", "\\N"), (f"y{i}", '"q')], "a string, b string")
        files.write_raw_tsv(df.coalesce(1), f"{raw}/{i}")
        ingest()
    ingest()
    table = spark.read.parquet(out)
    assert sorted(r["a"] for r in table.collect()) == ["x0", "x1", "x2", "y0", "y1", "y2"]
    assert {r["b"] for r in table.collect()} == {"\\N", '"q'}
    assert table.select("_batch_id", "_source_file").distinct().count() == 3


@pytest.fixture
def arrivals(spark):
    """A folder that receives Parquet files one at a time."""
    source = scratch_path(spark, "arrivals")
    count = iter(range(100))

    def arrive(df):
        df.coalesce(1).write.parquet(f"{source}/{next(count)}")
        return spark.readStream.schema(df.schema).parquet(f"{source}/*")

    arrive.folder = source
    return arrive


def test_upsert_log(spark, arrivals, rows):
    target, ckpt = scratch_path(spark, "target"), scratch_path(spark, "ckpt")
    shape = "k int, v string, ts int"
    for batch in ([(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(1, "late", 0), (2, "d", 5)], [(3, "e", 1)]):
        jobs.stream_upsert(arrivals(spark.createDataFrame(batch, shape)), target, ["k"], "ts", ckpt)
    assert rows(jobs.read_upserted(spark, target, ["k"], "ts")) == [(1, "b", 2), (2, "d", 5), (3, "e", 1)]


LOADS = [[("k1", "a"), ("k2", "b")], [("k1", "a"), ("k2", "c"), ("k3", "d")], [("k2", "b")]]
TIMES = ["2024-01-01", "2024-02-01", "2024-03-01"]


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


def merged(frames, times):
    """Batch merges of the loads in time order."""
    label = lambda t: f"load-{t.replace('-', '')}000000"
    want = scd.first_load(frames[0], ["v"], stamp(times[0]), label(times[0]))
    for df, t in zip(frames[1:], times[1:]):
        want = scd.scd2_merge(want, df, "k", ["v"], stamp(t), label(t))
    return want


@pytest.mark.parametrize("runs", [[[0, 1, 2]], [[2], [0], [1]], [[0, 2], [1]]])
def test_history_does_not_depend_on_batches_or_order(spark, runs):
    source, target, ckpt = (scratch_path(spark, n) for n in ("loads", "target", "ckpt"))
    frames = [spark.createDataFrame(x, "k string, v string") for x in LOADS]
    shape = frames[0].withColumn("loaded_at", stamp(TIMES[0])).schema
    for run in runs:
        for i in run:
            frames[i].withColumn("loaded_at", stamp(TIMES[i])).write.parquet(f"{source}/{i}")
        jobs.stream_scd2(spark.readStream.schema(shape).parquet(f"{source}/*"), target, "k", ["v"], "loaded_at", ckpt)
    read = lambda df: sorted(map(str, df.select("k", "v", "valid_from", "valid_to", "is_current", "batch_id").collect()))
    want = read(merged(frames, TIMES))
    assert read(jobs.read_scd2(spark, target, "k")) == want
    smaller = scratch_path(spark, "smaller")
    jobs.compact_scd2(spark, target, smaller, "k", stamp("2024-02-15"))
    assert read(jobs.read_scd2(spark, smaller, "k")) == want
    assert spark.read.parquet(smaller).count() < spark.read.parquet(target).count()


def test_streamed_history_equals_batch_history_and_survives_replay(spark, arrivals):
    target, ckpt = scratch_path(spark, "target"), scratch_path(spark, "ckpt")
    times = TIMES
    frames = [spark.createDataFrame(x, "k string, v string") for x in LOADS]
    for df, t in zip(frames, times):
        stream = arrivals(df.withColumn("loaded_at", stamp(t)))
        jobs.stream_scd2(stream, target, "k", ["v"], "loaded_at", ckpt)
    want = merged(frames, times)
    read = lambda df: sorted(map(str, df.select("k", "v", "valid_from", "valid_to", "is_current", "batch_id").collect()))
    assert read(jobs.read_scd2(spark, target, "k")) == read(want)
    assert len(read(want)) == 5
    # The driver dies after writing the last batch and before noting it as done: the batch runs again.
    for name in ("2", ".2.crc"):
        os.remove(f"{ckpt}/commits/{name}")
    stream = spark.readStream.schema(stream.schema).parquet(f"{arrivals.folder}/*")
    jobs.stream_scd2(stream, target, "k", ["v"], "loaded_at", ckpt)
    assert read(jobs.read_scd2(spark, target, "k")) == read(want)


def minutes(*firing):
    start = dt.datetime(2024, 1, 1)
    return [("r", start + dt.timedelta(minutes=5 * i), f == "x") for i, f in enumerate(firing) if f != "-"]


SERIES = "xxx.xx-xxxx"  # x fires, . does not, - has no events


def test_held_needs_consecutive_windows(spark):
    windows = spark.createDataFrame(minutes(*SERIES), "rule string, window_start timestamp_ntz, firing boolean")
    got = sorted(r["window_start"].minute // 5 + r["window_start"].hour * 12 for r in jobs.held(windows, 3, 5, ["rule"]).collect())
    assert got == [2, 9, 10]


def test_held_stream_keeps_its_streak_between_batches(spark, arrivals):
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    rows = minutes(*SERIES)
    for part in (rows[:2], rows[2:8], rows[8:]):
        df = spark.createDataFrame(part, "rule string, window_start timestamp, firing boolean")
        alerts = jobs.held_stream(arrivals(df), 3, 5, "rule")
        writer = alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
        writer.trigger(availableNow=True).start().awaitTermination()
    got = sorted(r["window_start"].minute // 5 + r["window_start"].hour * 12 for r in spark.read.parquet(out).collect())
    assert got == [2, 9, 10]


def test_a_silent_key_ends_its_alert(spark, arrivals):
    """Key r holds and then stops coming; key s goes on and moves the watermark past r's missing window."""
    out, ckpt = scratch_path(spark, "out"), scratch_path(spark, "ckpt")
    start = dt.datetime(2024, 1, 1)
    other = [("s", start + dt.timedelta(minutes=5 * i), False) for i in range(12)]
    mine = minutes(*"xxxx")
    again = [("r", start + dt.timedelta(minutes=5 * i), i < 11) for i in (8, 9, 10, 11)]
    with jobs.timer_state(spark):
        for part in (mine + other[:4], other[4:6], other[6:8], other[8:10] + again[:2], other[10:] + again[2:]):
            df = spark.createDataFrame(part, "rule string, window_start timestamp, firing boolean")
            changes = jobs.held_changes(arrivals(df), 3, 5, "rule")
            writer = changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
            writer.trigger(availableNow=True).start().awaitTermination()
    place = lambda t: (t - start).total_seconds() // 300
    got = sorted((place(r["at"]), r["rule"], r["change"]) for r in spark.read.parquet(out).collect())
    assert got == [(2, "r", "held"), (4, "r", "ended"), (10, "r", "held"), (11, "r", "ended")]


def test_merged_sketches_are_near_the_exact_percentile(spark):
    df = spark.range(28_800).select(
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id") % 7200)).alias("ts"), (F.hash("id") % 100_000).cast("double").alias("v"))
    stored = jobs.windowed_sketches(df, "v", "5 minutes")
    assert stored.count() == 24
    found = {r["window_start"]: (r["events"], r["value"]) for r in jobs.merged_percentile(stored, 0.95, "1 hour", 0.0).collect()}
    hours = df.withColumn("h", F.window("ts", "1 hour")["start"])
    for r in hours.groupBy("h").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("v")).alias("all")).collect():
        events, value = found[r["h"]]
        rank = sum(v <= value for v in r["all"]) / r["n"]
        assert events == r["n"] == 14_400 and abs(rank - 0.95) < 0.005


@pytest.mark.parametrize("chunk", [60, 3600])
def test_rate_check_across_chunks(spark, chunk):
    """A burst over a chunk border, requests exactly at the limit and two at the same moment."""
    start = dt.datetime(2024, 1, 1, 0, 59, 30)
    times = [start + dt.timedelta(seconds=s) for s in (0, 10, 40, 60, 60, 101, 500)]
    df = spark.createDataFrame([("c", t) for t in times] + [("d", start)], "client string, ts timestamp_ntz")
    got = {r["ts"]: r["requests"] for r in jobs.rate_violations(df, "client", "ts", 2, 60, chunk).collect()}
    brute = {t: sum(1 for u in times if 0 <= (t - u).total_seconds() <= 60) for t in times}
    assert got == {t: n for t, n in brute.items() if n > 2}


def test_alert_windows(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=10 * i), "error" if i < 3 else "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string, v double")
    got = [(r["events"], r["ratio"], r["firing"]) for r in jobs.windowed_ratio(df, F.col("kind") == "error", "5 minutes", 0.1).orderBy("window_start").collect()]
    assert got == [(30, 0.1, False), (30, 0.0, False)]
    high = [r["value"] for r in jobs.windowed_percentile(df, "v", 0.95, "5 minutes", 50.0).orderBy("window_start").collect()]
    assert high == pytest.approx([27.55, 57.55])
    late = jobs.staleness(df, F.lit("2024-01-02 01:00:00").cast("timestamp_ntz"), 24).first()
    assert late["firing"]
