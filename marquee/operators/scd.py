"""Change data: versioned history, upserts, stage marks and rebuild plans.

No table format with MERGE is assumed. A merge is a DataFrame; writers put it in a new version folder, so a
path is never overwritten while it is read, and a repeated write of the same version replaces itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.scalars import attr_hash
from marquee.operators.ordering import one_per_group

VERSION_COLUMNS = ["valid_from", "valid_to", "is_current", "batch_id", "attr_hash"]


def first_load(df: DataFrame, attrs: Sequence[str], ts: Column, batch: str) -> DataFrame:
    """Every row as a current version."""
    return df.withColumns({
        "valid_from": ts, "valid_to": F.lit(None).cast("timestamp_ntz"), "is_current": F.lit(True),
        "batch_id": F.lit(batch), "attr_hash": attr_hash(attrs),
    })


def scd2_merge(
    current: DataFrame, incoming: DataFrame, key: str, attrs: Sequence[str], ts: Column, batch: str,
    expire_missing: bool = False,
) -> DataFrame:
    """All versions after a load.

    A current row whose attributes changed is closed at ``ts`` and followed by a new one; new keys are added;
    equal rows and closed versions stay as they are, so a repeated load changes nothing. Keys missing from the load
    stay current unless ``expire_missing``. ``incoming`` has one row per key.
    """
    columns = current.columns
    live, closed = current.filter("is_current"), current.filter("NOT is_current")
    staged = incoming.select(key, *attrs).withColumn("_new_hash", attr_hash(attrs)).withColumnsRenamed(
        {a: f"_new_{a}" for a in attrs}
    )
    both = live.join(staged, key, "full_outer")
    known, loaded = F.col("is_current").isNotNull(), F.col("_new_hash").isNotNull()
    changed = known & loaded & ~F.col("attr_hash").eqNullSafe(F.col("_new_hash"))
    ends = changed | (known & ~loaded) if expire_missing else changed
    kept = F.struct(*[
        {
            "valid_to": F.when(ends, ts).otherwise(F.col("valid_to")),
            "is_current": ~ends,
        }.get(c, F.col(c)).alias(c)
        for c in columns
    ])
    fresh_values = {
        key: F.col(key), "valid_from": ts, "valid_to": F.lit(None), "is_current": F.lit(True),
        "batch_id": F.lit(batch), "attr_hash": F.col("_new_hash"), **{a: F.col(f"_new_{a}") for a in attrs},
    }
    types = {f.name: f.dataType for f in current.schema.fields}
    fresh = F.struct(*[fresh_values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in columns])
    versions = F.array_compact(F.array(F.when(known, kept), F.when(loaded & (~known | changed), fresh)))
    merged = both.select(F.explode(versions).alias("_v")).select("_v.*")
    return closed.unionByName(merged)


def overwrite(df: DataFrame, path: str) -> None:
    """Reload a table as a whole."""
    df.write.mode("overwrite").parquet(path)


def upsert(target: DataFrame, delta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key is not in the delta, and the delta."""
    kept = target.join(delta.select(*keys).distinct(), list(keys), "left_anti")
    return kept.select(*target.columns).unionByName(delta, allowMissingColumns=True)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Newest change per key; resolves an append-only change table on read."""
    return one_per_group(df, keys, order)


def since(df: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Rows newer than the newest one of the target; all rows if the target is empty."""
    newest = target.agg(F.max(column)).scalar()
    return df.withColumn("_newest", newest).filter(F.col("_newest").isNull() | (F.col(column) > F.col("_newest"))).drop("_newest")


def current(df: DataFrame) -> DataFrame:
    return df.filter("is_current")


def as_of(df: DataFrame, moment: Column) -> DataFrame:
    """Versions valid at a moment."""
    return df.filter((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))


def stage(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Staging projection: source column to staged name."""
    return df.select(*[F.col(a).alias(b) for a, b in mapping.items()])


class Checkpoint:
    """Finished stages of a run, kept as small append-only Parquet files.

    Stages are ordered; a finished stage implies the earlier ones.
    """

    SCHEMA = "pipeline string, stage string, batch_id string, marked_at timestamp"

    def __init__(self, spark: SparkSession, path: str, stages: Sequence[str]):
        self.spark, self.path, self.stages = spark, path, list(stages)

    def table(self) -> DataFrame:
        """Newest mark per (pipeline, stage)."""
        marks = read_or_empty(self.spark, self.path, self.SCHEMA)
        return latest_per_key(marks, ["pipeline", "stage"], [F.desc("marked_at"), F.desc("batch_id")])

    def mark(self, pipeline: str, stage: str, batch: str) -> None:
        if stage not in self.stages:
            raise ValueError(f"unknown stage {stage}")
        row = self.spark.range(1).select(
            F.lit(pipeline).alias("pipeline"), F.lit(stage).alias("stage"), F.lit(batch).alias("batch_id"),
            F.current_timestamp().alias("marked_at"),
        )
        row.write.mode("append").parquet(self.path)

    def done(self, pipeline: str, stage: str, batch: str) -> bool:
        enough = self.stages[self.stages.index(stage):]
        marks = read_or_empty(self.spark, self.path, self.SCHEMA)
        hit = marks.filter((F.col("pipeline") == pipeline) & (F.col("batch_id") == batch) & F.col("stage").isin(enough))
        return not hit.isEmpty()


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder, or no rows where it does not exist yet."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def plan_rebuild(children: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(target, source, rebuild): which children to reload, given one verdict per *target* table.

    A verdict kept per source would let a child be skipped whose own load never finished. Anything but a clear
    NO_DELTA means rebuild.
    """
    joined = children.join(verdicts.select("target", "verdict"), "target", "left")
    return joined.select("target", "source", (F.coalesce("verdict", F.lit("UNKNOWN")) != "NO_DELTA").alias("rebuild"))
