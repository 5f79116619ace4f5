"""Ordering, pages and set operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.ordering import one_per_group

# Orders a caller may name; each gets the key as last criterion.
BROWSE_SORTS = {
    "rating": lambda: F.desc_nulls_last("average_rating"),
    "year": lambda: F.desc_nulls_last("start_year"),
    "title": lambda: F.asc_nulls_last("primary_title"),
    "votes": lambda: F.desc_nulls_last("num_votes"),
}


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows: each task keeps its own ``n``, nothing is fully sorted."""
    return df.orderBy(*order).limit(n)


def browse_sort(name: str | None, key: str = "tconst") -> list[Column]:
    pick = BROWSE_SORTS.get(name or "rating", BROWSE_SORTS["votes"])
    return [pick(), F.asc(key)]


def page(df: DataFrame, order: Sequence[Column], first: int, offset: int = 0) -> DataFrame:
    """One page with the total and the next offset (NULL on the last page) on every row."""
    total = df.agg(F.count("*").alias("total")).scalar()
    end = F.lit(offset + first).cast("long")
    rows = df.orderBy(*order).offset(offset).limit(first)
    return rows.withColumn("total", total).withColumn("next_offset", F.when(end < F.col("total"), end))


def first_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.select(key).orderBy(key).limit(n)


def key_digest(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def random_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows that look random and are the same on every run."""
    return df.orderBy(key_digest(key, seed), key).limit(n)


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def merge_unique(dfs: Sequence[DataFrame], key: str) -> DataFrame:
    """Concatenate; a key found in several inputs is taken from the first of them.

    Within an input the smallest row wins, so the result does not depend on task order.
    """
    tagged = union_all([df.withColumn("_source", F.lit(i)) for i, df in enumerate(dfs)])
    order = [F.asc("_source")] + [F.asc_nulls_last(c) for c in dfs[0].columns if c != key]
    return one_per_group(tagged, [key], order).drop("_source")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in ``a``, only in ``b``, and whether the sets are equal."""
    side = lambda df, flag: df.select(key).distinct().withColumn("_s", F.lit(flag))
    sides = side(a, 1).unionAll(side(b, 2)).groupBy(key).agg(F.sum("_s").alias("_s"))
    counts = sides.agg(
        F.count(F.when(F.col("_s") == 1, 1)).alias("only_left"), F.count(F.when(F.col("_s") == 2, 1)).alias("only_right")
    )
    return counts.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))
