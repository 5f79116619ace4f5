"""Multi-valued text columns as child tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.scalars import as_col, clean_nulls, split_list


def normalize_set(df: DataFrame, keys: Sequence[str], column: str, name: str, sep: str = ",") -> DataFrame:
    """Distinct (keys, item) rows of a separated column."""
    items = clean_nulls(df.select(*keys, column), columns=[column])
    return items.select(*keys, F.explode(split_list(column, sep)).alias(name)).distinct()


def normalize_ordered(
    df: DataFrame, keys: Sequence[str], column: str, name: str, ordinal: str = "ordering", sep: str = ","
) -> DataFrame:
    """One row per item with its position in the list from 1; repeats stay, empty items leave a gap."""
    items = clean_nulls(df.select(*keys, column), columns=[column])
    exploded = items.select(*keys, F.posexplode(F.split(F.col(column), f"[{sep}]")).alias("_pos", "_item"))
    listed = exploded.select(*keys, F.trim("_item").alias(name), (F.col("_pos") + 1).alias(ordinal))
    return listed.filter(F.col(name) != "")


def json_list(col: Column | str) -> Column:
    """A text such as ``["A","B, C"]`` as an array; escapes are honoured."""
    return F.from_json(as_col(col), "array<string>")


def bracket_list(col: Column | str) -> Column:
    """The same text split by its quotes alone, for inputs that are not strict JSON."""
    bare = F.regexp_replace(as_col(col), r"^\[?\"?|\"?\]?$", "")
    return F.filter(F.transform(F.split(bare, r"\",\s*\""), lambda i: F.trim(i)), lambda item: item != "")


def normalize_json_list(df: DataFrame, keys: Sequence[str], column: str, name: str, strict: bool = False) -> DataFrame:
    """Distinct (keys, item) rows of a JSON-style string list; ``strict`` reads it as JSON."""
    items = clean_nulls(df.select(*keys, column), columns=[column])
    parse = json_list if strict else bracket_list
    exploded = items.select(*keys, F.explode(parse(column)).alias(name))
    return exploded.filter(F.col(name) != "").distinct()


def explode_zip(df: DataFrame, first: str, second: str, keep: Sequence[str] = ()) -> DataFrame:
    """Two separated columns walked side by side; the shorter one is padded with nulls."""
    empty = F.array().cast("array<string>")
    pair = F.arrays_zip(
        F.coalesce(split_list(first), empty).alias("a"), F.coalesce(split_list(second), empty).alias("b")
    )
    return df.select(*keep, F.explode(pair).alias("_p")).select(
        *keep, F.col("_p.a").alias(first), F.col("_p.b").alias(second)
    )


def shard(df: DataFrame, key: str, shards: int | None = None) -> DataFrame:
    """Hash partition on a key, into the session's number of partitions: a ``distinct`` per partition is then a global one."""
    return df.repartition(key) if shards is None else df.repartition(shards, key)


def vocabulary(df: DataFrame, column: str, name: str = "item") -> DataFrame:
    """Items that occur in the fitting split."""
    return df.select(F.explode(split_list(column)).alias(name)).distinct()


def multi_hot_long(df: DataFrame, key: str, column: str, vocab: DataFrame, name: str = "item") -> DataFrame:
    """(key, item) for each item of the vocabulary; unseen items vanish.

    The long form grows with the data, not with rows x vocabulary.
    """
    items = df.select(key, F.explode(split_list(column)).alias(name)).distinct()
    return items.join(vocab, name, "left_semi").select(key, name)


def multi_hot(df: DataFrame, column: str, fit_on: Column, out: str = "features"):
    """Binary vector of the list column, vocabulary from the rows where ``fit_on`` holds.

    Returns ``(df with the vector, fitted model)``.
    """
    from pyspark.ml.feature import CountVectorizer

    empty = F.array().cast("array<string>")
    listed = df.withColumn("_items", F.coalesce(split_list(column), empty))
    model = CountVectorizer(inputCol="_items", outputCol=out, binary=True, minDF=1).fit(listed.filter(fit_on))
    return model.transform(listed).drop("_items"), model
