"""Ingest, history and alerting as Structured Streaming jobs.

The windowed measures take batch and streaming inputs alike. Writers use ``foreachBatch`` with one folder per
micro-batch, written in overwrite mode: a batch that is replayed after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marquee.functions.scalars import attr_hash
from marquee.operators.ordering import exact_quantiles, one_per_group
from marquee.sources.files import with_lineage

BATCH = "_batch"


def run_available(df: DataFrame, checkpoint: str, write) -> None:
    """Process everything that has arrived, then stop; ``write(batch, id)`` stores a micro-batch."""
    query = (
        df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()


def read_tsv_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Raw text files as they arrive, read as the batch scan reads them."""
    return (
        spark.readStream.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("escape", "")
        .option("nullValue", "\0").option("emptyValue", "").option("maxFilesPerTrigger", files_per_batch).csv(path)
    )


def stream_ingest(
    spark: SparkSession, path: str, schema: T.StructType, out: str, checkpoint: str, table: str, ts: Column, files_per_batch: int = 100
) -> None:
    """Take in each arriving file once, with lineage. The checkpoint replaces marker files."""
    source = read_tsv_stream(spark, path, schema, files_per_batch).withColumn("_file", F.col("_metadata.file_path"))

    def write(batch: DataFrame, batch_id: int) -> None:
        lined = with_lineage(batch, "", table, f"batch-{batch_id}", ts).withColumn("_source_file", F.col("_file")).drop("_file")
        lined.write.mode("overwrite").option("compression", "snappy").parquet(f"{out}/{BATCH}={batch_id}")

    run_available(source, checkpoint, write)


def stream_upsert(stream: DataFrame, target: str, keys: Sequence[str], order: str, checkpoint: str) -> None:
    """Append the newest change per key of each micro-batch; :func:`read_upserted` resolves the log.

    Only changes are written, so the cost of a batch does not depend on the size of the target.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = one_per_group(batch, keys, [F.desc(order), *_rest(batch, keys, order)])
        newest.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")

    run_available(stream, checkpoint, write)


def _rest(df: DataFrame, keys: Sequence[str], order: str) -> list[Column]:
    return [F.asc_nulls_last(c) for c in df.columns if c not in keys and c != order]


def read_upserted(spark: SparkSession, target: str, keys: Sequence[str], order: str) -> DataFrame:
    """Current rows of an upsert log."""
    log = spark.read.option("basePath", target).parquet(target)
    return one_per_group(log, keys, [F.desc(order), F.desc(BATCH)]).drop(BATCH)


def compact_upserts(spark: SparkSession, target: str, out: str, keys: Sequence[str], order: str) -> None:
    """Write an upsert log anew with one row per key. The caller points readers and the stream at ``out`` afterwards."""
    read_upserted(spark, target, keys, order).write.parquet(f"{out}/{BATCH}=-1")


def stream_scd2(
    stream: DataFrame, target: str, key: str, attrs: Sequence[str], loaded_at: str, checkpoint: str
) -> None:
    """Append every load of a stream to a log; :func:`read_scd2` makes the version history of it.

    The history follows from the load times alone, so neither the micro-batches nor a late load change it. A batch
    costs what its own rows cost.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(key, *attrs, F.col(loaded_at).alias("loaded_at")).withColumn("attr_hash", attr_hash(attrs))
        rows.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")

    run_available(stream, checkpoint, write)


def scd2_history(log: DataFrame, key: str) -> DataFrame:
    """Versions of the loads in a log (key, attributes, loaded_at, attr_hash), as merging them in time order gives them.

    A load of a key starts a version if its attributes differ from those of the load before. Of several rows with one
    key and load time the first in hash order counts. Keys missing from a load stay current.
    """
    first = one_per_group(log.drop(BATCH), [key, "loaded_at"], [F.asc("attr_hash")])
    before = F.lag("attr_hash").over(Window.partitionBy(key).orderBy("loaded_at"))
    changes = first.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col("attr_hash"))).drop("_before")
    following = F.lead("loaded_at").over(Window.partitionBy(key).orderBy("loaded_at"))
    return changes.withColumn("valid_to", following).withColumnRenamed("loaded_at", "valid_from").withColumns({
        "is_current": F.col("valid_to").isNull(), "batch_id": F.date_format("valid_from", "'load-'yyyyMMddHHmmss"),
    })


def read_scd2(spark: SparkSession, target: str, key: str) -> DataFrame:
    """All versions in a log of loads."""
    return scd2_history(spark.read.option("basePath", target).parquet(target), key)


def compact_scd2(spark: SparkSession, target: str, out: str, key: str, before: Column) -> None:
    """Write a log anew with repeated equal loads left out, as far as loads are older than ``before``.

    No load from before that moment may arrive later. The caller points readers and the stream at ``out`` afterwards.
    """
    log = spark.read.option("basePath", target).parquet(target)
    order = Window.partitionBy(key).orderBy("loaded_at", "attr_hash")
    marked = log.withColumn("_before", F.lag("attr_hash").over(order))
    kept = marked.filter((F.col("loaded_at") >= before) | F.col("_before").isNull() | (F.col("_before") != F.col("attr_hash")))
    kept.drop("_before", BATCH).write.parquet(f"{out}/{BATCH}=-1")


# Alerts


def _windowed(df: DataFrame, ts: str, size: str, late: str):
    """Group by tumbling window; a stream gets a watermark."""
    if df.isStreaming:
        df = df.withWatermark(ts, late)
    return df.groupBy(F.window(ts, size).alias("_w"))


def as_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Event-time columns must be TIMESTAMP for a watermark; local times are taken as the session's."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_ratio(df: DataFrame, condition: Column, size: str, limit: float, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """(window_start, events, ratio, firing): share of events that meet the condition per window."""
    measured = _windowed(df, ts, size, late).agg(F.count("*").alias("events"), F.avg(F.when(condition, 1.0).otherwise(0.0)).alias("ratio"))
    return measured.select(F.col("_w.start").alias("window_start"), "events", "ratio", (F.col("ratio") > limit).alias("firing"))


def windowed_percentile(df: DataFrame, column: str, p: float, size: str, limit: float, ts: str = "ts") -> DataFrame:
    """(window_start, value, firing) of a table: an exact percentile per window."""
    keyed = df.withColumn("window_start", F.window(ts, size)["start"])
    rows = exact_quantiles(keyed, column, [p], ["window_start"]).select("window_start", F.col("q0").alias("value"))
    return rows.withColumn("firing", F.col("value") > limit)


def windowed_percentile_approx(
    df: DataFrame, column: str, p: float, size: str, limit: float, ts: str = "ts", late: str = "10 minutes", accuracy: int = 10_000
) -> DataFrame:
    """The same for streams, and for tables that should give what the stream gives: a sketch of stated accuracy."""
    measured = _windowed(df, ts, size, late).agg(F.percentile_approx(column, p, accuracy).alias("value"))
    return measured.select(F.col("_w.start").alias("window_start"), "value").withColumn("firing", F.col("value") > limit)


def windowed_sketches(df: DataFrame, column: str, size: str, ts: str = "ts", late: str = "10 minutes", k: int = 800) -> DataFrame:
    """(window_start, events, sketch): a KLL sketch of each window, of a table or a stream. Sketches of stored windows can be
    merged to longer ones, so no event is read again. Ranks are off by about 1.7 / k ** 0.9 of the events (0.4% here)."""
    measured = _windowed(df, ts, size, late).agg(F.count(column).alias("events"), F.kll_sketch_agg_double(F.col(column).cast("double"), k).alias("sketch"))
    return measured.select(F.col("_w.start").alias("window_start"), "events", "sketch")


def merged_percentile(sketches: DataFrame, p: float, size: str, limit: float, k: int = 800) -> DataFrame:
    """(window_start, events, value, firing) of windows of ``size``, merged from the sketches of shorter ones."""
    longer = sketches.groupBy(F.window("window_start", size)["start"].alias("window_start"))
    merged = longer.agg(F.sum("events").alias("events"), F.kll_merge_agg_double("sketch", k).alias("_sketch"))
    value = F.when(F.col("events") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(p)))
    return merged.select("window_start", "events", value.alias("value")).withColumn("firing", F.col("value") > limit)


def staleness(df: DataFrame, ref: Column, hours: float, ts: str = "ts") -> DataFrame:
    """One row: hours since the newest event and whether that is too long."""
    micros = F.timestamp_diff("MICROSECOND", F.max(ts), ref)
    return df.agg((micros / 3.6e9).alias("age_hours")).withColumn("firing", F.col("age_hours") > hours)


def held(windows: DataFrame, n: int, minutes: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, window_start) of windows at which the alert has fired ``n`` windows in a row.

    Each firing window vouches for itself and the ``n - 1`` windows after it; a window with all its vouchers
    holds. No ordered pass over the whole series is needed.
    """
    step = F.make_dt_interval(mins=F.lit(minutes))
    covered = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("window_start") + step * i))
    vouched = windows.filter("firing").select(*keys, covered.alias("window_start"))
    return vouched.groupBy(*keys, "window_start").agg(F.count("*").alias("_n")).filter(F.col("_n") == n).drop("_n")


def held_stream(windows: DataFrame, n: int, minutes: int, key: str) -> DataFrame:
    """The same on a stream of stored window results (key, window_start, firing): a key's state is its streak.

    A window job appends windows once, in order, when the watermark closes them; this job follows that table.
    """
    step = pd.Timedelta(minutes=minutes)

    def advance(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, carried = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values("window_start")
        start, firing = rows["window_start"].astype("datetime64[us]"), rows["firing"].astype(bool)
        gap = start.diff() != step
        gap.iloc[0] = last is None or start.iloc[0] - pd.Timestamp(last, unit="us") != step
        # A run goes on as long as windows follow each other and fire; its length is a cumulative count.
        run = (gap | ~firing).cumsum()
        streak = firing.groupby(run).cumsum().astype(int)
        streak = streak + (run == 0) * carried
        hits = start[streak >= n]
        state.update((int(start.iloc[-1].value // 1000), int(streak.iloc[-1])))
        yield pd.DataFrame({key: [group[0]] * len(hits), "window_start": hits.to_numpy()})

    kind = windows.schema[key].dataType.simpleString()
    return windows.groupBy(key).applyInPandasWithState(
        advance, f"{key} {kind}, window_start timestamp", "last bigint, streak bigint", "append", GroupStateTimeout.NoTimeout
    )


class _Streak(StatefulProcessor):
    """State of one key: its last window, how many windows in a row have fired, and whether the alert is on."""

    def __init__(self, key: str, n: int, minutes: int):
        self.key, self.n, self.step = key, n, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("streak", "last bigint, streak bigint, active boolean")

    def _changes(self, key: tuple, found: list[tuple[str, int]]) -> pd.DataFrame:
        return pd.DataFrame({
            self.key: pd.Series([key[0]] * len(found), dtype=object), "change": pd.Series([kind for kind, _ in found], dtype=object),
            "at": pd.to_datetime([at for _, at in found], unit="us"),
        })

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, streak, active = self.state.get() if self.state.exists() else (None, 0, False)
        windows = pd.concat(list(rows)).sort_values("window_start")
        found = []
        for start, firing in zip(windows["window_start"].astype("datetime64[us]").astype("int64").tolist(), windows["firing"].tolist()):
            if last is not None and start <= last:
                continue  # a window comes once
            if last is not None and start != last + self.step:
                if active:
                    found.append(("ended", last + self.step))
                streak, active = 0, False
            streak = streak + 1 if firing else 0
            if active and not firing:
                found.append(("ended", start))
                active = False
            elif not active and streak >= self.n:
                found.append(("held", start))
                active = True
            last = start
        self.state.update((last, streak, active))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if active:  # the window after the next one tells that the next one is missing
            self.handle.registerTimer((last + 2 * self.step) // 1000)
        yield self._changes(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _, active = self.state.get()
        self.state.update((last, 0, False))
        yield self._changes(key, [("ended", last + self.step)] if active else [])

    def close(self) -> None:
        pass


def held_changes(windows: DataFrame, n: int, minutes: int, key: str, late: str = "0 seconds") -> DataFrame:
    """(key, change, at) of a stream of stored window results (key, window_start, firing): an alert is "held" at the ``n``-th
    window in a row that fires, and "ended" at the first one that doesn't or is missing.

    A timer in event time ends the alert of a key whose windows stop coming once the watermark, which all keys
    move, has passed the missing window. Needs the session that :func:`timer_state` sets up.
    """
    kind = windows.schema[key].dataType.simpleString()
    keyed = windows.withWatermark("window_start", late).groupBy(key)
    return keyed.transformWithStateInPandas(_Streak(key, n, minutes), f"{key} {kind}, change string, at timestamp", "Append", "EventTime")


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state where timers are possible."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rate_violations(events: DataFrame, client: str, ts: str, n: int, seconds: int, chunk_seconds: int = 3600) -> DataFrame:
    """(client, ts, requests) of events with more than ``n`` requests of their client in the trailing seconds.

    A client's time is cut into chunks. Each event also joins the next chunk if its window may be looked at from
    there, so every chunk is complete and a busy client spreads over many tasks.
    """
    micros, span, chunk = F.unix_micros(F.col(ts).cast("timestamp")), seconds * 1_000_000, max(chunk_seconds, seconds) * 1_000_000
    counted = events.groupBy(client, ts).agg(F.count("*").alias("_n")).withColumn("_t", micros)
    home = F.floor(F.col("_t") / chunk).alias("_home")
    last = F.floor((F.col("_t") + span) / chunk)
    placed = counted.select(client, ts, "_n", "_t", home).withColumn("_chunk", F.explode(F.sequence(F.col("_home"), last)))
    trailing = Window.partitionBy(client, "_chunk").orderBy("_t").rangeBetween(-span, 0)
    measured = placed.withColumn("requests", F.sum("_n").over(trailing))
    return measured.filter((F.col("_chunk") == F.col("_home")) & (F.col("requests") > n)).select(client, ts, "requests")
