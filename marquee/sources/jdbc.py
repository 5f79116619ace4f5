"""Reads from a relational database through Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.sources.files import map_columns

FETCH_ROWS = 10_000


def jdbc_options(
    url: str, table: str, bounds: tuple[str, object, object, int] | None = None, properties: Mapping[str, str] = {}
) -> dict[str, str]:
    """Reader options. ``bounds`` = (column, low, high, partitions) splits the read into ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": str(FETCH_ROWS), **properties}
    if bounds:
        column, low, high, parts = bounds
        options |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return options


def read_jdbc(
    spark: SparkSession, url: str, table: str, columns: Sequence[str] | None = None,
    bounds: tuple[str, object, object, int] | None = None, properties: Mapping[str, str] = {},
    mapping: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table, read in parallel ranges; selected columns and filters are pushed to the database."""
    df = spark.read.format("jdbc").options(**jdbc_options(url, table, bounds, properties)).load()
    if columns:
        df = df.select(*columns)
    return map_columns(df, mapping) if mapping else df


def read_query(spark: SparkSession, sql: str, url: str | None = None, properties: Mapping[str, str] = {}) -> DataFrame:
    """A query, run by the database at ``url`` or, without one, by Spark over its views."""
    if url is None:
        return spark.sql(sql)
    return spark.read.format("jdbc").options(url=url, query=sql, fetchsize=str(FETCH_ROWS), **properties).load()


def read_jdbc_incremental(spark: SparkSession, url: str, table: str, column: str, mark: str | None, **options) -> DataFrame:
    """Rows above a high-water mark; the comparison is pushed to the database."""
    df = read_jdbc(spark, url, table, **options)
    return df if mark is None else df.filter(F.col(column) > F.lit(mark).cast(df.schema[column].dataType))


def jdbc_row_count(spark: SparkSession, url: str, table: str, properties: Mapping[str, str] = {}) -> int:
    """Rows of a table; the database counts them."""
    return read_query(spark, f"SELECT count(*) AS n FROM {table}", url, properties).first()["n"]
