"""Sampling operators. All are repeatable: the MD5 of seed and key decides, on any engine alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.paging import key_digest, random_rows


def in_sample(key: str, percent: float, seed: int) -> Column:
    """Whether the key's digest falls into the first ``percent`` % of all digests."""
    if percent >= 100:
        return F.lit(True)
    return key_digest(key, seed) < format(int(percent / 100 * 16**8), "08x")


def key_sample(df: DataFrame, key: str, percent: float, seed: int = 42) -> DataFrame:
    """About ``percent`` % of the keys, with all their rows. Tables sampled on one key still join."""
    return df.filter(in_sample(key, percent, seed))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows in an order that the seed alone decides."""
    return random_rows(df, n, seed, key)


def subset_star(
    titles: DataFrame, people: DataFrame, performance: DataFrame, episodes: DataFrame, forced: DataFrame, pattern: str,
    sample: Column,
) -> dict[str, DataFrame]:
    """A referentially complete part of the star.

    Titles: forced keys, names that contain the pattern, and a sample; plus the series of every chosen episode.
    Facts and people follow from the titles.
    """
    wanted = titles.filter(F.contains("primary_title", F.lit(pattern)) | sample).select("tconst")
    chosen = wanted.unionByName(forced.select("tconst")).distinct()
    parents = episodes.join(chosen.withColumnRenamed("tconst", "episode_key"), "episode_key", "left_semi")
    series = parents.filter("series_key IS NOT NULL").select(F.col("series_key").alias("tconst"))
    keys = chosen.unionByName(series).distinct()
    credits = performance.join(keys, "tconst", "left_semi")
    return {
        "dim_title": titles.join(keys, "tconst", "left_semi"),
        "fact_performance": credits,
        "fact_episode": parents,
        "dim_person": people.join(credits.select("nconst").distinct(), "nconst", "left_semi"),
    }
