"""File sources and sinks: raw text, lineage, fingerprints, schema alignment and mart export."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyarrow import fs as pa_fs
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.ordering import one_per_group
from marquee.operators.scd import path_exists, read_or_empty

# Raw columns per source file, all text.
# The columns of the raw files.
RAW_COLUMNS = {
    "title.basics": ["tconst", "titleType", "primaryTitle", "originalTitle", "isAdult", "startYear", "endYear", "runtimeMinutes", "genres"],
    "title.akas": ["titleId", "ordering", "title", "region", "language", "types", "attributes", "isOriginalTitle"],
    "title.crew": ["tconst", "directors", "writers"],
    "title.episode": ["tconst", "parentTconst", "seasonNumber", "episodeNumber"],
    "title.principals": ["tconst", "ordering", "nconst", "category", "job", "characters"],
    "title.ratings": ["tconst", "averageRating", "numVotes"],
    "name.basics": ["nconst", "primaryName", "birthYear", "deathYear", "primaryProfession", "knownForTitles"],
}

BATCH_LOG = "batch_id string, source string, checksum string, row_count bigint, status string, logged_at timestamp"
FINGERPRINTS = "name string, row_count bigint, column_names string, stats_md5 string, saved_at timestamp"
WATERMARKS = "name string, mark string, updated_at timestamp"
EPOCH = "1970-01-01T00:00:00+00:00"


def fails_to_read(error: Exception) -> bool:
    """Whether a job failed on its rows or files, or a path has none; a plan that can't be made is an error of the program."""
    return not isinstance(error, AnalysisException) or error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def raw_schema(source: str) -> T.StructType:
    return text_schema(RAW_COLUMNS[source])


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_raw_tsv(spark: SparkSession, path: str, schema: T.StructType, partitions: int | None = None) -> DataFrame:
    """Tab-separated text with a header: every column text, quotes are plain characters, short rows padded.

    The null marker stays as it is. A gzip file is read by one task; give ``partitions`` to spread what follows.
    """
    df = (
        spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("escape", "")
        .option("nullValue", "\0").option("emptyValue", "").option("mode", "PERMISSIVE").csv(path)
    )
    return df.repartition(partitions) if partitions else df


def write_raw_tsv(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """The raw layout, for fixtures and exchange."""
    df.write.option("sep", "\t").option("header", True).option("quote", "\0").option("escapeQuotes", False).option(
        "emptyValue", "").option("compression", compression).mode("overwrite").csv(path)


def validate_source(spark: SparkSession, path: str, n_cols: int) -> tuple[DataFrame, DataFrame, str | None]:
    """(good lines, bad lines, problem) of a tab-separated file; ``problem`` is set if it is missing or empty."""
    lines = "value string, n_columns int"
    if not path_exists(spark, path):
        empty = spark.createDataFrame([], lines)
        return empty, empty, "missing"
    text = spark.read.text(path).withColumn("n_columns", F.size(F.split("value", "\t")))
    good, bad = text.filter(F.col("n_columns") == n_cols), text.filter(F.col("n_columns") != n_cols)
    return good, bad, "empty" if text.isEmpty() else None


def _hash_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        sums = []
        for uri in frame["path"]:
            filesystem, name = pa_fs.FileSystem.from_uri(uri)
            digest = hashlib.sha256()
            with filesystem.open_input_stream(name, compression=None) as stream:
                while chunk := stream.read(1 << 20):
                    digest.update(chunk)
            sums.append(digest.hexdigest())
        yield frame.assign(checksum=sums)


def file_checksums(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, checksum) of each matching file. Files are read in pieces by the tasks, so any size will do."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    spread = files.repartition(F.col("path"))
    return spread.mapInPandas(_hash_files, "path string, length bigint, checksum string")


def with_lineage(
    df: DataFrame, source: str, table: str, batch: str, ts: Column, rows: Column | None = None, checksum: str | None = None
) -> DataFrame:
    """Lineage columns. ``rows`` defaults to the size of the input, counted as a scalar subquery."""
    rows = df.agg(F.count("*")).scalar() if rows is None else rows
    return df.withColumns({
        "_source_file": F.lit(source), "_source_table": F.lit(table), "_batch_id": F.lit(batch), "_ingested_at": ts,
        "_row_count": rows, "_checksum": F.lit(checksum).cast("string"),
    })


def write_counted(df: DataFrame, path: str) -> int:
    """Snappy Parquet, counted while it is written; the number of rows."""
    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "snappy").parquet(path)
    return written.get.get("rows", 0)


def write_bronze(df: DataFrame, path: str) -> bool:
    """Snappy Parquet; an input without rows writes nothing and returns False."""
    if df.isEmpty():
        return False
    write_counted(df, path)
    return True


def log_batch(spark: SparkSession, path: str, batch: str, source: str, checksum: str | None, rows: int, status: str) -> None:
    """Append one line to the batch log."""
    spark.range(1).select(
        F.lit(batch).alias("batch_id"), F.lit(source).alias("source"), F.lit(checksum).cast("string").alias("checksum"),
        F.lit(rows).cast("bigint").alias("row_count"), F.lit(status).alias("status"), F.current_timestamp().alias("logged_at"),
    ).write.mode("append").parquet(path)


def needs_ingest(spark: SparkSession, log: str, source: str, stored: str) -> bool:
    """False only when the newest finished batch of a source has as many rows as the stored table."""
    done = read_or_empty(spark, log, BATCH_LOG).filter((F.col("source") == source) & (F.col("status") == "success"))
    newest = done.orderBy(F.desc("logged_at")).limit(1).first()
    return newest is None or not path_exists(spark, stored) or newest["row_count"] != parquet_row_count(spark, stored)


def parquet_row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table; no column is decoded."""
    return spark.read.parquet(path).count()


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """One row: row count, columns and an MD5 over each column's name, type, minimum, maximum and null count."""
    def stat(field: T.StructField) -> Column:
        c = F.col(field.name)
        ordered = not isinstance(field.dataType, (T.MapType, T.VariantType))
        low, high = (F.min(c), F.max(c)) if ordered else (F.lit(None), F.lit(None))
        if isinstance(field.dataType, T.FractionalType) and not isinstance(field.dataType, T.DecimalType):
            low, high = low + 0.0, high + 0.0  # a negative zero is a zero
        parts = [F.lit(field.name), F.lit(field.dataType.simpleString())]
        parts += [F.coalesce(F.to_json(F.struct(x.alias("v"))), F.lit("")) for x in (low, high)]
        return F.concat_ws("|", *parts, F.count_if(c.isNull()).cast("string"))

    stats = F.array_join(F.array_sort(F.array(*[F.md5(stat(f)) for f in df.schema.fields])), ",")
    return df.agg(
        F.lit(name).alias("name"), F.count("*").alias("row_count"),
        F.lit(json.dumps(df.columns)).alias("column_names"), F.md5(stats).alias("stats_md5"),
    )


def check_delta(new: DataFrame, saved: DataFrame) -> DataFrame:
    """(name, verdict) for fingerprints: NO_DELTA only if a saved one is equal, UNKNOWN if none is saved."""
    columns = ["row_count", "column_names", "stats_md5"]
    old = saved.select("name", F.struct(*columns).alias("_old"))
    joined = new.select("name", F.struct(*columns).alias("_new")).join(old, "name", "left")
    verdict = F.when(F.col("_old").isNull(), "UNKNOWN").when(F.col("_old") == F.col("_new"), "NO_DELTA").otherwise("DELTA")
    return joined.select("name", verdict.alias("verdict"))


class FingerprintStore:
    """Fingerprints of finished loads. Call :meth:`save` after the load is committed, never before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        rows = read_or_empty(self.spark, self.path, FINGERPRINTS)
        return one_per_group(rows, ["name"], [F.desc("saved_at"), F.desc("stats_md5")]).drop("saved_at")

    def save(self, fingerprints: DataFrame) -> None:
        fingerprints.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def verdict(self, df: DataFrame, name: str) -> str:
        """Verdict for one source; one that cannot be read needs full processing. Errors of the program are raised."""
        try:
            return check_delta(fingerprint(df, name), self.load()).first()["verdict"]
        except (PySparkException, Py4JJavaError) as error:
            if not fails_to_read(error):
                raise
            return "UNKNOWN"


class WatermarkStore:
    """High-water marks as an append-only table; the newest mark of a name counts, a cleared one is null."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def all(self) -> DataFrame:
        rows = read_or_empty(self.spark, self.path, WATERMARKS)
        newest = one_per_group(rows, ["name"], [F.desc("updated_at"), F.desc_nulls_last("mark")])
        return newest.filter("mark IS NOT NULL").select("name", "mark")

    def get(self, name: str) -> str:
        """The mark; the epoch if there is none or the store cannot be read. Errors of the program are raised."""
        try:
            row = self.all().filter(F.col("name") == name).first()
        except (PySparkException, Py4JJavaError) as error:
            if not fails_to_read(error):
                raise
            return EPOCH
        return row["mark"] if row else EPOCH

    def set(self, name: str, mark: str | None) -> None:
        self.update(self.spark.range(1).select(F.lit(name).alias("name"), F.lit(mark).cast("string").alias("mark")))

    def clear(self, name: str) -> None:
        self.set(name, None)

    def update(self, marks: DataFrame) -> None:
        """Append (name, mark) rows."""
        marks.select("name", F.col("mark").cast("string").alias("mark"), F.current_timestamp().alias("updated_at")).write.mode(
            "append").parquet(self.path)


def latest_watermark(df: DataFrame, column: str, name: str) -> DataFrame:
    """(name, mark): the largest value as text, compared as text; the epoch for no rows."""
    return df.agg(F.lit(name).alias("name"), F.coalesce(F.max(F.col(column).cast("string")), F.lit(EPOCH)).alias("mark"))


def read_incremental(df: DataFrame, column: str, mark: Column | str | None) -> DataFrame:
    """Rows above a high-water mark; everything if there is none."""
    if mark is None:
        return df
    return df.filter(F.col(column) > mark)


def map_columns(df: DataFrame, mapping: Mapping[str, str], reverse: bool = False) -> DataFrame:
    """Rename by a source-to-target map and drop what it does not name; ``reverse`` goes back."""
    pairs = [(b, a) if reverse else (a, b) for a, b in mapping.items()]
    return df.select([F.col(a).alias(b) for a, b in pairs if a in df.columns])


def infer_mapped_schema(df: DataFrame, mapping: Mapping[str, str]) -> T.StructType:
    """The schema a mapped read will have."""
    fields = [T.StructField(mapping[f.name], f.dataType, f.nullable) for f in df.schema.fields if f.name in mapping]
    return T.StructType(fields)


def align_schema(
    df: DataFrame, target: T.StructType, exclude: Sequence[str] = ()
) -> tuple[DataFrame, list[str], list[str]]:
    """(df with every target column, columns added, columns only in df). Nothing is ever dropped."""
    wanted = [f for f in target.fields if f.name not in exclude]
    added = [f.name for f in wanted if f.name not in df.columns]
    extra = [c for c in df.columns if c not in target.names and c not in exclude]
    new = {f.name: F.lit(None).cast(f.dataType) for f in wanted if f.name in added}
    return (df.withColumns(new) if new else df), added, extra


def evolve_as_text(df: DataFrame, source_columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add source columns that a table lacks, as text."""
    return align_schema(df, text_schema(source_columns))[:2]


def exportable_titles(titles: DataFrame) -> DataFrame:
    """Titles for export: movies need a positive runtime."""
    return titles.filter((F.col("title_type") != "movie") | (F.col("runtime_minutes") > 0))


def export_marts(
    tables: Mapping[str, DataFrame], path: str, filters: Mapping[str, object] = {"dim_title": exportable_titles}
) -> DataFrame:
    """Write each table under ``path``, counted in the same pass, and return the manifest (table_name, row_count), also
    written there."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        kept = filters[name](df) if name in filters else df
        rows.append((name, write_counted(kept, f"{path}/{name}")))
    manifest = spark.createDataFrame(rows, "table_name string, row_count bigint")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")
    return manifest


def register_marts(spark: SparkSession, path: str, names: Sequence[str], prefix: str = "") -> list[str]:
    """Temporary views over exported marts."""
    for name in names:
        spark.read.parquet(f"{path}/{name}").createOrReplaceTempView(prefix + name)
    return [prefix + name for name in names]


def collect_bounded(df: DataFrame, max_rows: int = 50_000):
    """The result as pandas, or an error if it is larger than allowed; never more than one row too many is fetched."""
    frame = df.limit(max_rows + 1).toPandas()
    if len(frame) > max_rows:
        raise ValueError(f"result exceeds {max_rows} rows")
    return frame


def sources_ready(spark: SparkSession, pattern: str, n: int = 7) -> bool:
    """Whether at least ``n`` files match. Only the listing is used; no content is read."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.limit(n).count() >= n
