"""Joins of the catalogue. Sides are broadcast only by Spark's own size check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assemble(base: DataFrame, sides: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join many one-row-per-key sides to a base on the same key.

    All joins share the key, so the base is shuffled once.
    """
    for side in sides:
        base = base.join(side, key, "left")
    return base


def episodes_with_series(
    episodes: DataFrame, titles: DataFrame, parent: str = "parent_tconst", types: Sequence[str] = ("tvSeries", "tvMiniSeries")
) -> DataFrame:
    """Episodes with their current series, if the parent is one."""
    series = titles.filter(F.col("is_current") & F.col("title_type").isin(list(types))).select(
        F.col("tconst").alias(parent),
        F.col("primary_title").alias("series_title"),
        F.col("start_year").alias("series_start_year"),
        F.col("title_type").alias("series_type"),
    )
    return episodes.join(series, parent, "left")


def expand_left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which several right rows multiply a left row."""
    return left.join(right, list(keys), "left")


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: Column, how: str = "inner") -> DataFrame:
    """Join to a side with one row per key, of which some match too many left rows for one task.

    ``hot`` marks those rows of ``right``. There can be no more of them than left rows divided by the hot
    size, so they are broadcast; their left rows are spread over all tasks in the other join.
    """
    keys = list(keys)
    values = [c for c in right.columns if c not in keys]
    packed = right.select(*keys, hot.alias("_is_hot"), F.struct(*values).alias("_matched"))
    few = packed.filter("_is_hot").select(*keys, F.col("_matched").alias("_hot"))
    rest = packed.filter("NOT _is_hot").select(*keys, F.lit(0).alias("_salt"), F.col("_matched").alias("_cold"))
    # The salt decides only where a row is handled, so it may differ between equal rows and between attempts.
    spread = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int"))
    marked = left.join(F.broadcast(few), keys, "left").withColumn("_salt", spread)
    found = marked.join(rest, [*keys, "_salt"], "left").withColumn("_matched", F.coalesce("_hot", "_cold"))
    if how == "inner":
        found = found.filter(F.col("_matched").isNotNull())
    return found.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"_matched.{c}").alias(c) for c in values])


def pairs(
    df: DataFrame, group: str, item: str, keep: Sequence[str] = (), both: Sequence[str] = (), largest: int | None = None,
    block_rows: int = 5_000,
) -> DataFrame:
    """Unordered pairs (``item_a`` < ``item_b``) of the distinct (group, item) rows of ``df`` that share a group.

    ``keep`` columns belong to the group and are carried once, ``both`` columns belong to the item and get a
    suffix. ``largest`` bounds the group size; without it groups are counted first. Beyond ``block_rows`` a group
    is cut into blocks of items and each pair of blocks is joined on its own, so no task holds a whole large group.
    """
    a = df.select(group, *keep, *[F.col(c).alias(f"{c}_a") for c in (item, *both)])
    b = df.select(group, *[F.col(c).alias(f"{c}_b") for c in (item, *both)])
    if largest is None:
        largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    on = [group]
    if largest > block_rows:
        sizes = df.groupBy(group).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
        own = lambda column: F.pmod(F.xxhash64(column), F.col("_blocks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
        a = a.join(sizes, group).withColumn("_i", own(f"{item}_a")).withColumn("_j", every).drop("_blocks")
        b = b.join(sizes, group).withColumn("_j", own(f"{item}_b")).withColumn("_i", every).drop("_blocks")
        on = [group, "_i", "_j"]
    joined = a.join(b, on).filter(F.col(f"{item}_a") < F.col(f"{item}_b"))
    return joined.drop("_i", "_j")


def collaborators(credits: DataFrame, person_id, k: int | None = None, group: str = "tconst", item: str = "nconst") -> DataFrame:
    """People who share titles with one person, most shared credits first."""
    credits = credits.select(group, item)
    mine = credits.filter(F.col(item) == person_id).groupBy(group).agg(F.count("*").alias("_mine"))
    shared = credits.filter(F.col(item) != person_id).join(mine, group)
    found = shared.groupBy(item).agg(F.sum("_mine").alias("collab_count"))
    return found if k is None else found.orderBy(F.desc("collab_count"), item).limit(k)


def restrict(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def new_versions(staged: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Staged rows with no equal row (nulls equal nulls) among the current ones."""
    right = current.select(*[F.col(k).alias(f"_cur_{k}") for k in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_cur_{k}"))
    return staged.join(right, condition, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows without a parent, rows with a null key included. Those never move: they are orphans as they are."""
    keys = parent.select(F.col(pk).alias("_pk"))
    keyed = child.filter(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("_pk"), "left_anti")
    return keyed.unionAll(child.filter(F.col(fk).isNull()))


def cross_scalar(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row result; each becomes a scalar subquery, so nothing is joined."""
    return df.withColumns({c: scalars.select(c).scalar() for c in scalars.columns})


def latest_snapshot(df: DataFrame, column: str = "snapshot_date") -> DataFrame:
    """Rows of the newest snapshot."""
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def recompute_list(
    credits: DataFrame, people: DataFrame, role: str, name: str, sep: str = ", ", total_order: Sequence[str] = ("ordering", "nconst")
) -> DataFrame:
    """Per title the names of everyone in a role, in billing order."""
    named = credits.filter(F.col("category") == role).join(people.select("nconst", "primary_name"), "nconst")
    return ordered_concat(named, ["tconst"], "primary_name", total_order, name, sep)


def ordered_concat(
    df: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column | str], name: str, sep: str = ", "
) -> DataFrame:
    """Values of a group joined in a stated order; null values are left out."""
    item = F.struct(*order, F.col(value).alias("_value"))
    gathered = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    return gathered.select(*keys, F.array_join(F.col("_items._value"), sep).alias(name))


def genre_year_join(genres: DataFrame, stats: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Each title's genres (one row per title and genre) with the statistics of the genre in the title's year, if any."""
    return genres.select("tconst", "genre", "start_year").join(stats.select("genre", "start_year", *keep), ["genre", "start_year"], "left").select("tconst", "genre", *keep)


def lookup(facts: DataFrame, dimension: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A large table with columns of a dimension that has one row per key; rows without a match keep nulls. The facts are
    shuffled once, or not at all where Spark measures the dimension as small."""
    return facts.join(dimension.select(key, *columns), key, "left")


def crew_stats_join(crew: DataFrame, stats: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Equi-join on several differently named keys."""
    right = stats.withColumnsRenamed({r: f"_r_{r}" for r in on.values()})
    condition = F.lit(True)
    for left_name, right_name in on.items():
        condition = condition & (F.col(left_name) == F.col(f"_r_{right_name}"))
    return crew.join(right, condition).drop(*[f"_r_{r}" for r in on.values()])


def _worth_pairing(side: DataFrame, other: DataFrame, person: str, n: str, other_n: str, min_n: int) -> DataFrame:
    """Keep people whose best case over all their titles reaches ``min_n`` joint credits with someone."""
    best = other.groupBy("tconst").agg(F.max(other_n).alias("_most"))
    reach = side.join(best, "tconst").groupBy(person).agg(F.sum(F.col(n) * F.col("_most")).alias("_reach"))
    return side.join(reach.filter(F.col("_reach") >= min_n), person, "left_semi")


def role_pairs(credits: DataFrame, role_a: str, role_b: str, min_n: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """(tconst, a, b, n): joint credits of people in two roles of the same title; ``keep`` carries title columns.

    Credits are counted per title and person first. With ``min_n`` above 1, people who cannot reach it with
    anybody are dropped before the join, which also empties a title of countless one-off credits.
    """
    counted = credits.filter(F.col("category").isin(role_a, role_b)).groupBy("tconst", "category", "nconst", *keep).agg(
        F.count("*").alias("n")
    )
    a = counted.filter(F.col("category") == role_a).select("tconst", *keep, F.col("nconst").alias("a"), F.col("n").alias("na"))
    b = counted.filter(F.col("category") == role_b).select("tconst", F.col("nconst").alias("b"), F.col("n").alias("nb"))
    if min_n > 1:
        a, b = _worth_pairing(a, b, "a", "na", "nb", min_n), _worth_pairing(b, a, "b", "nb", "na", min_n)
    return a.join(b, "tconst").select("tconst", "a", "b", (F.col("na") * F.col("nb")).alias("n"), *keep)
