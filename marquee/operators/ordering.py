"""Ranks, positions and exact quantiles that do not need one group, or the whole table, inside one task.

The rows of a large group are cut into ranges along their sort order, of similar size for any distribution. A rank is then
the size of the earlier ranges plus the position inside the range. Quantiles of large groups are selected digit by digit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.functions.scalars import as_col
from marquee.session import shared_dir

LEAST_SLICES = 64
HOT_ROWS = 5_000_000  # above this a group no longer belongs in one sort task


def one_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group. Every map task passes on one row per group at most."""
    return top_per_group(df, keys, order, 1).drop("_rank")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "_rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered. Spark limits each group before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(name) <= k)


def slices(spark: SparkSession) -> int:
    """Into how many slices a large group is cut: a power of two, at least as many as the session's partitions, so the
    number of tasks grows with what the cluster was set up for."""
    wanted = max(LEAST_SLICES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return 1 << (wanted - 1).bit_length()


def _cut_points(df: DataFrame, n: int) -> DataFrame:
    """One row: sampled values of the order struct ``_o``, sorted."""
    sample = df.select("_o").orderBy(F.xxhash64("_o"), "_o").limit(n - 1)
    return sample.agg(F.array_sort(F.collect_list("_o")).alias("_cuts"))


def _with_slice(df: DataFrame, n: int) -> DataFrame:
    """Add ``_slice``, the number of ``_cuts`` not above ``_o``, by binary search; 0 without cuts."""
    df = df.withColumn("_slice", F.lit(0))
    step = n // 2
    while step:
        passed = F.get("_cuts", F.col("_slice") + (step - 1)) <= F.col("_o")
        df = df.withColumn("_slice", F.col("_slice") + F.when(passed, step).otherwise(0))
        step //= 2
    return df


def rank_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str = "rank",
    hot_rows: int = HOT_ROWS,
    largest: int | None = None,
    total: str | None = None,
) -> DataFrame:
    """``row_number`` over ``keys`` in ascending ``order`` (which must be total and free of nulls), and the size of
    the group where ``total`` names a column for it.

    ``largest`` is a known upper bound of the group size; without it the sizes are counted first. If no group
    exceeds ``hot_rows`` this is a plain window. Otherwise all rows are cut into ranges of group and order, which are
    checkpointed because several passes read them; nothing is gathered or joined by group alone.
    """
    order = [as_col(o) for o in order]
    if largest is None:
        counted = df.groupBy(*keys).count() if keys else df.groupBy().count()
        largest = counted.agg(F.max("count")).first()[0] or 0
    if largest <= hot_rows:
        group = Window.partitionBy(*keys)
        ranked = df.withColumn(name, F.row_number().over(group.orderBy(*order)).cast("long"))
        return ranked.withColumn(total, F.count("*").over(group)) if total else ranked

    shared_dir(df.sparkSession)
    columns, n = df.columns, slices(df.sparkSession)
    # Structs as keys: unlike a null, a struct of nulls equals itself in joins, so a null group is cut too.
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    keyed = df.withColumns({"_g": group, "_o": F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])})
    # Ranges of (group, order) are about equal in size whatever the groups are; the number of a range is kept with its rows.
    ranged = keyed.repartitionByRange(n, "_g", "_o").withColumn("_range", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("_g", "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_g")  # a row per range of a group from here
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_g", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    placed = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_g", "_range").orderBy("_o")))
    numbered = placed.join(offsets, ["_g", "_range"])
    rank = (F.col("_in") + F.col("_before")).cast("long").alias(name)
    return numbered.select(*columns, rank, *([F.col("_total").alias(total)] if total else []))


def over_groups(
    df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column], hot_rows: int = HOT_ROWS, largest: int | None = None
) -> DataFrame:
    """Aggregates of its group on every row, as a window over ``keys`` gives them.

    Groups above ``hot_rows`` (there are at most rows / hot_rows of them) are aggregated apart and broadcast, and
    their rows are spread over all tasks. ``largest`` is a known upper bound of the group size.
    """
    if largest is None:
        largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= hot_rows:
        return df.withColumns({name: agg.over(Window.partitionBy(*keys)) for name, agg in aggs.items()})
    values = [agg.alias(name) for name, agg in aggs.items()]
    sums = df.groupBy(*keys).agg(F.count("*").alias("_n"), *values).filter(F.col("_n") > hot_rows)
    few = sums.select(F.struct(*keys).alias("_g"), F.struct(*aggs).alias("_hot"))
    marked = df.withColumn("_g", F.struct(*keys)).join(F.broadcast(few), "_g", "left").drop("_g")
    # The salt decides only where a row is handled, so it may differ between equal rows and between attempts.
    spread = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1024)).cast("int"))
    window = Window.partitionBy(*keys, "_salt")
    own = {name: F.coalesce(F.col("_hot")[name], agg.over(window)) for name, agg in aggs.items()}
    return marked.withColumn("_salt", spread).withColumns(own).drop("_hot", "_salt")


def dense_index(df: DataFrame, column: str, name: str, count: str = "count") -> DataFrame:
    """(value, 0-based position in sorted order, number of rows) for each distinct non-null value of ``column``.

    No task sees more than one slice of the values.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(count))
    values = values.withColumn("_o", F.struct(F.col(column)))
    n = slices(df.sparkSession)
    sliced = _with_slice(values.withColumn("_cuts", _cut_points(values, n).scalar()), n)
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(column)) - 1
    return (
        sliced.select(column, count, "_slice", inside.alias("_in"))
        .join(F.broadcast(offsets), "_slice")  # a row per slice
        .select(column, (F.col("_in") + F.col("_before")).cast("long").alias(name), count)
    )


# Distinct values up to which a group is sorted in one task; beyond it positions are found digit by digit.
SORTED_VALUES = 1 << 20
DIGITS = (42, 21, 0)  # what is left of a 64-bit key after each digit


def order_key(column: Column, integral: bool) -> Column:
    """A 64-bit number that orders like the column: itself, or the IEEE bits of a double with the sign as sign. NaN comes last."""
    if integral:
        return column.cast("long")
    value = column.cast("double")
    size = F.abs(value)
    near = F.floor(F.log2(size))  # may be one off
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))  # exact for whole exponents
    exponent = near + F.when(power(near) > size, -1).when(size >= 2 * power(near), 1).otherwise(0)
    normal = (exponent + 1023) * (1 << 52) + ((size / power(exponent) - 1) * float(1 << 52)).cast("long")
    bits = (
        F.when(size == 0, F.lit(0)).when(size < 2.0**-1022, (size / 5e-324).cast("long")).when(size == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    )
    return F.when(F.isnan(value), F.lit((1 << 63) - 1)).when(value < 0, -bits).otherwise(bits)


def _edges(pos: Column) -> list[Column]:
    return [F.floor(pos), F.ceil(pos)]


def _interpolated(low: Column, high: Column, pos: Column) -> Column:
    return low + (high - low) * (pos - F.floor(pos))


def _sorted_quantiles(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Quantiles of groups that fit a task: one running sum of the counts."""
    group = Window.partitionBy("_g")
    upto = F.sum("_c").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_hi", upto).withColumn("n", F.sum("_c").over(group))

    def at(place: Column) -> Column:
        return F.max(F.when((place < F.col("_hi")) & (place >= F.col("_hi") - F.col("_c")), F.col("_v").cast("double")))

    positions = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    found = placed.groupBy("_g", "n").agg(*[at(edge).alias(f"_{side}{i}") for i, pos in enumerate(positions) for side, edge in zip("ab", _edges(pos))])
    values = [_interpolated(F.col(f"_a{i}"), F.col(f"_b{i}"), pos).alias(f"q{i}") for i, pos in enumerate(positions)]
    return found.select("_g", "n", *values)


def _selected_quantiles(counts: DataFrame, probs: Sequence[float], integral: bool) -> DataFrame:
    """Quantiles of any group, digit by digit of the order key.

    A round counts rows per next digit, at most two million per group and wanted position, and goes on inside the digit that
    holds the position. Counting combines before the shuffle, so a hot group is no burden to one task, and no row meets
    more than the few digits still wanted.
    """
    keyed = counts.withColumn("_k", order_key(F.col("_v"), integral))
    wanted, before = None, None
    for left in DIGITS:
        part, here = keyed, ["_g"]
        if wanted is not None:
            part, here = keyed.withColumn("_in", F.shiftright("_k", before)).join(wanted, ["_g", "_in"]), ["_g", "_in"]
        kept = [] if wanted is None else [F.any_value("n").alias("n"), F.any_value("_places").alias("_places")]
        digit = F.shiftright("_k", left).alias("_digit")
        sums = part.groupBy(*here, digit).agg(F.sum("_c").alias("_c"), F.max("_v").alias("_v"), *kept)
        group = Window.partitionBy(*here)
        upto = F.sum("_c").over(group.orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("_hi", upto).withColumn("_lo", F.col("_hi") - F.col("_c"))
        if wanted is None:
            sums = sums.withColumn("n", F.sum("_c").over(group))
            places = [e.cast("long") for p in probs for e in _edges(F.lit(float(p)) * (F.col("n") - 1))]
            sums = sums.withColumn("_places", F.array(*[F.struct(F.lit(i).alias("i"), place.alias("at")) for i, place in enumerate(places)]))
        # Places inside this digit, counted from its first row.
        inside = F.filter("_places", lambda x: (x["at"] >= F.col("_lo")) & (x["at"] < F.col("_hi")))
        inside = F.transform(inside, lambda x: F.struct(x["i"].alias("i"), (x["at"] - F.col("_lo")).alias("at")))
        wanted = sums.withColumn("_places", inside).filter(F.size("_places") > 0).select("_g", "n", F.col("_digit").alias("_in"), "_places", "_v")
        before = left
        if left:
            wanted = wanted.drop("_v")
    ends = wanted.select("_g", "n", "_v", F.explode("_places.i").alias("_i"))
    value = lambda i: F.max(F.when(F.col("_i") == i, F.col("_v").cast("double")))
    found = ends.groupBy("_g", "n").agg(*[value(2 * i + side).alias(f"_{'ab'[side]}{i}") for i in range(len(probs)) for side in (0, 1)])
    positions = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    values = [_interpolated(F.col(f"_a{i}"), F.col(f"_b{i}"), pos).alias(f"q{i}") for i, pos in enumerate(positions)]
    return found.select("_g", "n", *values)


def exact_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], keys: Sequence[str] = (), sorted_values: int = SORTED_VALUES, different: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, as columns ``n, q0, q1, ...`` per group; null keys form groups too.

    ``percentile`` would hold every distinct value of a group in one task. Here equal values are counted first. Groups with
    at most ``sorted_values`` different ones are sorted; larger ones, which are few, never meet in a task. ``different`` is a
    known upper bound of the different values of a group; without it they are counted first. Nulls are left out; NaN is
    larger than all numbers.
    """
    keys, integral = list(keys), df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))  # a struct of nulls equals itself in joins
    counts = df.filter(F.col(column).isNotNull()).select(group.alias("_g"), F.col(column).alias("_v")).groupBy("_g", "_v").agg(F.count("*").alias("_c"))
    sizes = counts.groupBy("_g").agg(F.count("*").alias("_different"))
    if different is None:
        different = sizes.agg(F.max("_different")).first()[0] or 0
    if different <= sorted_values:
        found = _sorted_quantiles(counts, probs)
    else:
        large = sizes.filter(F.col("_different") > sorted_values).select("_g")
        found = _sorted_quantiles(counts.join(large, "_g", "left_anti"), probs)
        found = found.unionByName(_selected_quantiles(counts.join(large, "_g", "left_semi"), probs, integral))
    return found.select(*[F.col(f"_g.{k}").alias(k) for k in keys], "n", *[f"q{i}" for i in range(len(probs))])
