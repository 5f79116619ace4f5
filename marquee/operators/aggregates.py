"""Aggregations: grouped statistics, pivots, shares, histograms and survival curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.scalars import as_col
from marquee.operators.ordering import exact_quantiles

SMOOTHING = 1e-10


def group_stats(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], having: Column | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggs.items()])
    return out if having is None else out.filter(having)


def count_by_category(df: DataFrame, key: str, column: str, values: Sequence[str], suffix: str = "_count") -> DataFrame:
    """One count column per listed category, in one pass."""
    counts = [F.count(F.when(F.col(column) == v, 1)).alias(f"{v}{suffix}") for v in values]
    return df.groupBy(key).agg(*counts)


def count_distinct(df: DataFrame, keys: Sequence[str], column: str, name: str, approx: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approx else F.count_distinct
    return df.groupBy(*keys).agg(fn(column).alias(name))


def aka_summary(akas: DataFrame) -> DataFrame:
    """Region and language lists over distinct (region, language) pairs with a region.

    ``aka_count`` counts those pairs; ``aka_rows`` counts all alternative titles.
    """
    per_pair = akas.groupBy("title_id", "region", "language").agg(F.count("*").alias("n"))
    item = F.struct("region", F.coalesce("language", F.lit("")).alias("tie"), "language")
    rows = per_pair.groupBy("title_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("region").isNotNull(), item))).alias("items"),
        F.sum("n").alias("aka_rows"),
    )
    size = F.size("items")
    return rows.select(
        "title_id",
        F.when(size > 0, F.array_join(F.col("items.region"), ", ")).alias("region_list"),
        F.when(
            F.size(F.filter("items", lambda i: i["language"].isNotNull())) > 0, F.array_join(F.col("items.language"), ", ")
        ).alias("language_list"),
        F.when(size > 0, size.cast("long")).alias("aka_count"),
        "aka_rows",
    )


def arg_max(df: DataFrame, keys: Sequence[str], value: str, by: Column | str, name: str, tie: Column | str) -> DataFrame:
    """Value at the largest ``by``; among equals the smallest ``tie`` (a number)."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(as_col(by), -as_col(tie))).alias(name))


def trim_quantiles(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows between two quantiles of a column, found without gathering its values."""
    found = exact_quantiles(df, column, [low, high])
    edged = df.withColumns({"_low": found.select("q0").scalar(), "_high": found.select("q1").scalar()})
    return edged.filter(F.col(column).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def pivot_matrix(df: DataFrame, row: str, col: str, value: Column, columns: Sequence, fill=0) -> DataFrame:
    """Rows x columns matrix; the column list is given, so no pass is spent on finding it."""
    out = df.groupBy(row).pivot(col, list(columns)).agg(value)
    return out if fill is None else out.fillna(fill)


def pivot_roles(df: DataFrame, key: str, role: str, roles: Mapping[str, str], values: Mapping[str, str]) -> DataFrame:
    """One column per (role, value): ``roles`` maps role to prefix, ``values`` maps source column to suffix."""
    picks = [
        F.max(F.when(F.col(role) == r, F.col(c))).alias(f"{prefix}_{suffix}")
        for r, prefix in roles.items()
        for c, suffix in values.items()
    ]
    return df.groupBy(key).agg(*picks)


def proportion(df: DataFrame, group: Sequence[str], members: Sequence[str], name: str = "proportion") -> DataFrame:
    """Count per (group, member) and its share of the group. The counts are small, the rows are not."""
    counts = df.groupBy(*group, *members).agg(F.count("*").alias("cnt"))
    totals = counts.groupBy(*group).agg(F.sum("cnt").alias("_total"))
    return counts.join(totals, list(group)).withColumn(name, F.col("cnt") / F.col("_total")).drop("_total")


def survival_curve(df: DataFrame, group: str, length: str, max_t: int = 60) -> DataFrame:
    """Share of each group whose length exceeds t, for t = 1..max_t.

    Lengths are counted first, capped at max_t + 1 (all of those exceed every t), so each group expands from at
    most max_t + 2 rows.
    """
    capped = F.least(F.greatest(F.col(length), F.lit(0)), F.lit(max_t + 1)).alias("len")
    counts = df.filter(F.col(length).isNotNull()).groupBy(group, capped).agg(F.count("*").alias("n"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(max_t))).alias("t")
    over = F.sum(F.when(F.col("len") > F.col("t"), F.col("n")).otherwise(0))
    return counts.select(group, "len", "n", steps).groupBy(group, "t").agg((over / F.sum("n")).alias("survival"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows minus distinct key combinations (nulls count as values)."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """1..bins with the maximum in the last bin; NULL outside the edges. A zero range is widened by half each way."""
    flat = low == high
    start = F.when(flat, low - 0.5).otherwise(low)
    width = F.when(flat, F.lit(1.0)).otherwise(high - low)
    place = F.least(F.floor((value - start) / width * bins) + 1, F.lit(bins))
    return F.when((value >= low) & (value <= high), place.cast("int"))


def column_edges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with a struct (lo, hi) per column, from one aggregate."""
    spans = [F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns]
    return df.agg(F.struct(*spans).alias("edges"))


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 20, edges: DataFrame | None = None) -> DataFrame:
    """(feature, bin, n, prob): equal-width histograms of several columns in one scan.

    ``edges`` (see :func:`column_edges`) may come from another data set. Probabilities get the smoothing constant
    (relative to the density) and sum to one; a column without values is uniform.
    """
    edges = column_edges(df, columns) if edges is None else edges
    span = F.col("_span")  # a column first, so that the subquery is planned once
    binned = df.select(*columns).withColumn("_span", edges.scalar()).withColumns({
        f"_bin_{c}": bin_index(F.col(c).cast("double"), span[c]["lo"], span[c]["hi"], bins) for c in columns
    })
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_bin_{c}").alias("bin")) for c in columns])
    counted = (
        binned.select(F.explode(entries).alias("_e")).select("_e.*").filter("bin IS NOT NULL")
        .groupBy("feature", "bin").agg(F.count("*").alias("n"))
    )
    spans = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"edges.{c}.lo").alias("low"), F.col(f"edges.{c}.hi").alias("high")) for c in columns])
    grid = edges.select(F.explode(spans).alias("_e")).select("_e.*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    full = grid.join(counted, ["feature", "bin"], "left").fillna(0, ["n"])
    whole = Window.partitionBy("feature")  # ``bins`` rows each
    total = F.sum("n").over(whole)
    width = F.when(F.col("low") == F.col("high"), F.lit(1.0)).otherwise(F.col("high") - F.col("low")) / bins
    density = full.withColumn("_d", F.when(total > 0, F.col("n") / (total * width) + SMOOTHING).otherwise(F.lit(1.0)))
    return density.select("feature", "bin", "n", (F.col("_d") / F.sum("_d").over(whole)).alias("prob"))


def top_categories(df: DataFrame, column: str, n: int, weight: Column | None = None) -> DataFrame:
    """The ``n`` most frequent values; equal counts go by name."""
    weight = F.count("*") if weight is None else weight
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(weight.alias("cnt"))
    return counts.orderBy(F.desc("cnt"), column).limit(n)


def restrict_to_top(df: DataFrame, column: str, n: int, weight: Column | None = None) -> DataFrame:
    return df.join(top_categories(df, column, n, weight).select(column), column, "left_semi")
