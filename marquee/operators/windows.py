"""Windowed measures written so that a large group does not land in one sort task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.ordering import one_per_group, over_groups, rank_within, top_per_group


def collaboration_rank(
    df: DataFrame, pair: Sequence[str], votes: str, tie: str, name: str = "collaboration_rank", **bounds
) -> DataFrame:
    """Position of each shared title of a pair, most voted first, unvoted last, then by ``tie``."""
    lowest = F.lit(2**63 - 1)
    return rank_within(df, pair, [F.coalesce(-F.col(votes), lowest), F.col(tie)], name, **bounds)


def partition_total(df: DataFrame, keys: Sequence[str], name: str, **bounds) -> DataFrame:
    """Group size on every row."""
    return over_groups(df, keys, {name: F.count("*")}, **bounds)


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return one_per_group(df, keys, order)


def debut_year(df: DataFrame, keys: Sequence[str], year: str, name: str = "debut_year", **bounds) -> DataFrame:
    """First year of the group on every row."""
    return over_groups(df, keys, {name: F.min(year)}, **bounds)


def yearly_credits(df: DataFrame, keys: Sequence[str], year: str, span: int = 5) -> DataFrame:
    """Per (keys, year): credits that year, before it, within ``span`` years up to it, and the debut.

    Credits are counted per year first, so a window group has one row per active year.
    """
    counts = df.groupBy(*keys, year).agg(F.count("*").alias("credits"))
    by_year = Window.partitionBy(*keys).orderBy(year)
    return counts.select(
        *keys,
        year,
        "credits",
        F.coalesce(F.sum("credits").over(by_year.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("credits_before"),
        F.sum("credits").over(by_year.rangeBetween(-span, 0)).alias("recent_credits"),
        F.min(year).over(Window.partitionBy(*keys)).alias("debut_year"),
    )


def explode_run(df: DataFrame, keys: Sequence[str], count: str, name: str, run: int = 10_000) -> DataFrame:
    """One row per number 1..``count`` of each row. Long runs are cut into pieces that spread over the tasks."""
    pieces = F.explode(F.sequence(F.lit(0), F.floor((F.col(count) - 1) / run)))
    spread = df.filter(F.col(count) > 0).withColumn("_piece", pieces).repartition(*keys, "_piece")
    numbers = F.sequence(F.col("_piece") * run + 1, F.least((F.col("_piece") + 1) * run, F.col(count)))
    return spread.withColumn(name, F.explode(numbers)).drop("_piece")


def cumulative_credits(df: DataFrame, keys: Sequence[str], year: str, name: str = "cumulative_credits") -> DataFrame:
    """One row per credit with its running number; within a year the numbers are given in no special order."""
    runs = explode_run(yearly_credits(df, keys, year), [*keys, year], "credits", "_i")
    return runs.select(*keys, year, (F.col("credits_before") + F.col("_i")).alias(name))


def recent_credits(df: DataFrame, keys: Sequence[str], year: str, span: int = 5, name: str = "recent_credits") -> DataFrame:
    """One row per credit with the number of credits in the trailing years."""
    runs = explode_run(yearly_credits(df, keys, year, span), [*keys, year], "credits", "_i")
    return runs.select(*keys, year, F.col("recent_credits").alias(name))


def top_k(df: DataFrame, user: str, score: str, tie: str, k: int, name: str = "rank") -> DataFrame:
    return top_per_group(df, [user], [F.desc(score), F.asc(tie)], k, name)
