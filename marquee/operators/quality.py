"""Data quality checks. Each returns rows (check_name, table_name, metric_name, metric_value, threshold, passed).

Checks over one table share one aggregate where they can. Rates are plain fractions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.functions.scalars import has_item
from marquee.operators.aggregates import duplicate_keys
from marquee.operators.joins import orphans, recompute_list
from marquee.operators.paging import union_all

NEVER_LOADED_HOURS = 999_999.0
RESULT_COLUMNS = ["check_name", "table_name", "metric_name", "metric_value", "threshold", "passed"]


def share(condition: Column) -> Column:
    """Fraction of rows for which a condition holds; 0 for no rows."""
    return F.count(F.when(condition, 1)) / F.greatest(F.count("*"), F.lit(1))


def result(df: DataFrame, check: str, table: str, metric: str, value: Column | str, threshold: float, passed: Column | None = None) -> DataFrame:
    """Shape a one-row aggregate as a check result; it passes up to the threshold unless told otherwise."""
    value = (F.col(value) if isinstance(value, str) else value).cast("double")
    return df.select(
        F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), F.lit(metric).alias("metric_name"),
        value.alias("metric_value"), F.lit(float(threshold)).alias("threshold"),
        F.coalesce(value <= threshold if passed is None else passed, F.lit(False)).alias("passed"),
    )


def null_rate(df: DataFrame, column: str, threshold: float, check: str, table: str) -> DataFrame:
    return result(df.agg(share(F.col(column).isNull()).alias("v")), check, table, "null_rate", "v", threshold)


def orphan_rate(child: DataFrame, parent: DataFrame, fk: str, pk: str, threshold: float, check: str, table: str) -> DataFrame:
    lost = orphans(child.select(fk), parent, fk, pk).agg(F.count("*").alias("lost"))
    total = child.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    return result(lost, check, table, "orphan_rate", F.col("lost") / total, threshold)


def row_count_variance(
    df: DataFrame, threshold: float, check: str, table: str, expected: int = 0, minimum: int = 0
) -> DataFrame:
    """Relative distance of the row count from the expected count, else from the minimum, else 0."""
    base = expected or minimum
    value = F.abs(F.count("*") - base) / base if base else F.lit(0.0)
    return result(df.agg(value.alias("v")), check, table, "row_count_variance", "v", threshold)


def age_hours(newest: Column, now: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", newest.cast("timestamp_ntz"), now.cast("timestamp_ntz"))
    return F.coalesce(micros / 3.6e9, F.lit(NEVER_LOADED_HOURS))


def freshness(df: DataFrame, column: str, now: Column, hours: float, check: str, table: str) -> DataFrame:
    return result(df.agg(age_hours(F.max(column), now).alias("v")), check, table, "freshness", "v", hours)


def apply_alert(results: DataFrame, alert_pct: float = 20.0) -> DataFrame:
    """A passing check whose value is above the alert level fails and logs a second row."""
    level = alert_pct / 100
    alarmed = F.col("passed") & (F.col("metric_value") > level)
    main = F.struct(*[F.col(c) for c in RESULT_COLUMNS[:-1]], (F.col("passed") & ~alarmed).alias("passed"))
    extra = F.struct(
        F.concat("check_name", F.lit("_alert")).alias("check_name"), F.col("table_name"), F.lit("row_count_deviation").alias("metric_name"),
        F.col("metric_value"), F.lit(level).alias("threshold"), F.lit(False).alias("passed"),
    )
    both = F.array_compact(F.array(main, F.when(alarmed, extra)))
    return results.select(F.explode(both).alias("_r")).select("_r.*")


@dataclass(frozen=True)
class Check:
    """One configured check."""

    name: str
    table: str
    metric: str
    threshold: float
    severity: str = "error"
    alert_pct: float = 20.0
    options: Mapping[str, object] = field(default_factory=dict)

    def run(self, tables: Mapping[str, DataFrame], now: Column) -> DataFrame:
        df, o = tables[self.table], self.options
        if self.metric == "null_rate":
            rows = null_rate(df, o["column"], self.threshold, self.name, self.table)
        elif self.metric == "orphan_rate":
            rows = orphan_rate(df, tables[o["pk_table"]], o["fk_column"], o["pk_column"], self.threshold, self.name, self.table)
        elif self.metric == "row_count_variance":
            rows = row_count_variance(
                df, self.threshold, self.name, self.table, o.get("expected_count", 0), o.get("expected_min", 0)
            )
        elif self.metric == "freshness":
            hours = o.get("sla_hours", self.threshold)
            return freshness(df, o.get("column", "ingested_at"), now, hours, self.name, self.table)
        else:
            raise ValueError(f"unknown metric {self.metric}")
        return apply_alert(rows, self.alert_pct) if self.alert_pct > 0 else rows


def run_checks(
    tables: Mapping[str, DataFrame], checks: Sequence[Check], now: Column, batch: str, log_path: str | None = None,
    quarantine_path: str | None = None,
) -> DataFrame:
    """All results with severity and batch. With paths, results are appended to the log and failed errors to
    the quarantine list; a check that cannot be built (a table is missing, say) becomes a failed row."""
    parts = []
    for check in checks:
        try:
            rows = check.run(tables, now)
        except Exception as error:
            spark = next(iter(tables.values())).sparkSession
            rows = result(spark.range(1), check.name, check.table, f"error: {type(error).__name__}", F.lit(None), check.threshold)
        parts.append(rows.withColumn("severity", F.lit(check.severity)))
    out = union_all(parts).withColumn("batch_id", F.lit(batch))
    if log_path:
        out.withColumn("logged_at", now).write.mode("append").parquet(log_path)
        out = out.sparkSession.read.parquet(log_path).filter(F.col("batch_id") == batch).drop("logged_at")
    if quarantine_path:
        out.filter("NOT passed AND severity = 'error'").write.mode("append").parquet(quarantine_path)
    return out


def freshness_sla(tables: Mapping[str, DataFrame], hours: Mapping[str, float], ref: Column, column: str = "ingested_at") -> DataFrame:
    """Age of each table's newest row against its limit, all relative to one reference time."""
    return union_all([freshness(df, column, ref, hours[name], f"freshness_{name}", name) for name, df in tables.items()])


def expect_not_null(df: DataFrame, mostly: Mapping[str, float], table: str, min_rows: int = 1) -> DataFrame:
    """Row count and not-null shares of several columns, in one aggregate."""
    measured = df.agg(F.count("*").alias("_rows"), *[(1 - share(F.col(c).isNull())).alias(c) for c in mostly])
    entry = lambda name, value, floor: F.struct(
        F.lit(name).alias("check_name"), value.cast("double").alias("metric_value"), F.lit(float(floor)).alias("threshold")
    )
    entries = [entry("row_count", F.col("_rows"), min_rows)]
    entries += [entry(f"not_null_{c}", F.col(c), floor) for c, floor in mostly.items()]
    rows = measured.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
    return rows.select(
        "check_name", F.lit(table).alias("table_name"), F.lit("expectation").alias("metric_name"), "metric_value", "threshold",
        (F.col("metric_value") >= F.col("threshold")).alias("passed"),
    )


def fk_suite(tables: Mapping[str, DataFrame], rules: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """(fk_check, orphan_count) for rules (child, fk, parent, pk)."""
    return union_all([
        orphans(tables[child].select(fk), tables[parent], fk, pk).agg(F.count("*").alias("orphan_count")).select(
            F.lit(f"{child}.{fk}").alias("fk_check"), "orphan_count"
        )
        for child, fk, parent, pk in rules
    ])


def validate_contract(
    df: DataFrame, table: str, columns: Mapping[str, bool], min_rows: int = 0,
    parents: Mapping[str, tuple[DataFrame, str]] = {},
) -> DataFrame:
    """(rule, subject, violations) for a contract: ``columns`` maps name to nullable, ``parents`` fk to (table, pk)."""
    spark = df.sparkSession
    missing = [c for c in columns if c not in df.columns]
    present = [c for c, nullable in columns.items() if not nullable and c in df.columns]
    shape = "rule string, subject string, violations bigint"
    rows = spark.createDataFrame([("missing_column", c, 1) for c in missing], shape)
    measured = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in present])
    entry = lambda rule, subject, value: F.struct(
        F.lit(rule).alias("rule"), F.lit(subject).alias("subject"), value.cast("bigint").alias("violations")
    )
    entries = [entry("minimum_rows", table, F.greatest(F.lit(min_rows) - F.col("_rows"), F.lit(0)))]
    entries += [entry("null", c, F.col(c)) for c in present]
    rows = rows.unionByName(measured.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*"))
    for fk, (parent, pk) in parents.items():
        lost = orphans(df.select(fk).filter(F.col(fk).isNotNull()), parent, fk, pk).agg(F.count("*").alias("n"))
        rows = rows.unionByName(lost.select(entry("orphan", fk, F.col("n")).alias("_e")).select("_e.*"))
    return rows.withColumn("passed", F.col("violations") == 0)


def unique(df: DataFrame, column: str, table: str) -> DataFrame:
    """Values (other than null) that occur more than once."""
    repeated = df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").agg(F.count("*").alias("v"))
    return result(repeated, f"unique_{column}", table, "repeated_values", "v", 0)


def not_null(df: DataFrame, column: str, table: str) -> DataFrame:
    return result(df.agg(F.count_if(F.col(column).isNull()).alias("v")), f"not_null_{column}", table, "null_rows", "v", 0)


def accepted_range(
    df: DataFrame, column: str, table: str, low: float | None = None, high: float | None = None, severity: str = "error"
) -> DataFrame:
    """Rows outside [low, high]; an open end is not checked, null rows pass."""
    outside = F.lit(False)
    if low is not None:
        outside = outside | (F.col(column) < low)
    if high is not None:
        outside = outside | (F.col(column) > high)
    rows = result(df.agg(F.count_if(outside).alias("v")), f"range_{column}", table, "rows_outside", "v", 0)
    return rows.withColumn("severity", F.lit(severity))


def unique_combo(df: DataFrame, columns: Sequence[str], table: str) -> DataFrame:
    return result(duplicate_keys(df, columns), f"unique_{'_'.join(columns)}", table, "duplicates", "duplicates", 0)


def variance_vs_log(df: DataFrame, log: DataFrame, check: str, metric: str, threshold: float = 0.2) -> DataFrame:
    """Violation row when the count differs from the last passing logged one by more than the threshold."""
    passing = log.filter((F.col("check_name") == check) & (F.col("metric_name") == metric) & F.col("passed"))
    last = passing.agg(F.max_by("metric_value", F.struct("logged_at", "metric_value"))).scalar()
    counted = df.agg(F.count("*").alias("current_row_count")).withColumn("previous_row_count", F.coalesce(last, F.lit(0.0)))
    deviation = F.abs(F.col("current_row_count") - F.col("previous_row_count")) / F.col("previous_row_count")
    known = counted.filter("previous_row_count > 0").withColumn("deviation_ratio", deviation)
    return known.filter(F.col("deviation_ratio") > threshold)


def count_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n)."""
    return union_all([df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()])


def layer_ratios(pairs: Mapping[str, tuple[DataFrame, DataFrame]], low: float = 0.95, high: float = 1.05) -> DataFrame:
    """(pair, before, after, ratio, ok) of row counts between layers; no ratio without rows before."""
    return union_all([
        before.agg(F.count("*").alias("before")).withColumn("after", after.agg(F.count("*")).scalar()).select(
            F.lit(name).alias("pair"), "before", "after",
            (F.col("after") / F.nullif(F.col("before"), F.lit(0))).alias("ratio"),
        )
        for name, (before, after) in pairs.items()
    ]).withColumn("ok", F.coalesce(F.col("ratio").between(low, high), F.lit(False)))


def compare_counts(a: DataFrame, b: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """One row: rows and distinct keys of two layers and whether they agree."""
    sides = [(a, key, "left"), (b, other_key or key, "right")]
    left, right = [
        df.agg(F.count("*").alias(f"{side}_rows"), F.count_distinct(k).alias(f"{side}_keys")) for df, k, side in sides
    ]
    both = left.withColumns({c: right.select(c).scalar() for c in right.columns})
    return both.withColumns({
        "rows_match": F.col("left_rows") == F.col("right_rows"), "keys_match": F.col("left_keys") == F.col("right_keys"),
    })


def value_mismatch(a: DataFrame, b: DataFrame, key: str, column: str, tol: float = 0.01) -> DataFrame:
    """One row: keys with values on both sides, and those that differ by more than the tolerance."""
    left, right = a.select(key, F.col(column).alias("_a")), b.select(key, F.col(column).alias("_b"))
    both = left.join(right, key).filter("_a IS NOT NULL AND _b IS NOT NULL")
    return both.agg(F.count("*").alias("compared"), F.count_if(F.abs(F.col("_a") - F.col("_b")) > tol).alias("mismatched"))


def missing_keys(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.select(key).distinct().join(parent.select(key), key, "left_anti")


def validity_rules(df: DataFrame, table: str, rules: Mapping[str, Column]) -> DataFrame:
    """(table_name, rule, violations): rows for which each rule's condition holds, in one aggregate."""
    counted = df.agg(*[F.count_if(condition).alias(name) for name, condition in rules.items()])
    entries = [F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules]
    return counted.select(F.explode(F.array(*entries)).alias("_e")).select(F.lit(table).alias("table_name"), "_e.*")


def bad_parent_type(episodes: DataFrame, titles: DataFrame) -> DataFrame:
    """One row: distinct series keys that are unknown or not a television title."""
    kinds = titles.select(F.col("tconst").alias("series_key"), F.col("title_type").alias("_type"))
    keys = episodes.filter("series_key IS NOT NULL").select("series_key").distinct()
    wrong = F.coalesce(~F.col("_type").contains("tv"), F.lit(True))
    return keys.join(kinds, "series_key", "left").agg(F.count_if(wrong).alias("bad_series"))


def list_consistency(titles: DataFrame, credits: DataFrame, people: DataFrame, role: str, column: str) -> DataFrame:
    """One row: titles whose stored name list equals the one recomputed from the credits, over all titles."""
    again = recompute_list(credits, people, role, "_again")
    both = titles.filter(F.col(column).isNotNull()).select("tconst", column).join(again, "tconst", "left")
    differs = F.coalesce(F.col(column) != F.col("_again"), F.lit(False))
    rate = 100.0 * (1 - share(differs))
    return both.agg(F.count("*").alias("compared"), F.count_if(differs).alias("mismatched"), rate.alias("match_rate")).withColumn(
        "ok", F.col("match_rate") > 90
    )


def manifest_drift(manifest: DataFrame, counts: DataFrame, limit: float = 0.01) -> DataFrame:
    """(table_name, declared, actual, drift, ok) against an export manifest."""
    joined = counts.select("table_name", F.col("n").alias("actual")).join(
        manifest.select("table_name", F.col("row_count").alias("declared")), "table_name", "left"
    )
    drift = F.abs(F.col("actual") - F.col("declared")) / F.nullif(F.col("declared"), F.lit(0))
    return joined.withColumn("drift", drift).withColumn("ok", F.coalesce(F.col("drift") <= limit, F.lit(False)))


def null_profile(df: DataFrame, table: str, limit: float = 0.05) -> DataFrame:
    """(table_name, column_name, null_share, high) for every column, in one aggregate."""
    measured = df.agg(*[share(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_share")) for c in df.columns]
    rows = measured.select(F.explode(F.array(*entries)).alias("_e")).select(F.lit(table).alias("table_name"), "_e.*")
    return rows.withColumn("high", F.col("null_share") > limit)


def min_volume(counts: DataFrame, minimums: Mapping[str, int]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in minimums.items() for x in pair])
    return counts.withColumn("minimum", F.element_at(table, F.col("table_name")).cast("bigint")).withColumn(
        "ok", F.col("n") >= F.col("minimum")
    )


def recency(df: DataFrame, column: str, now_year: int, years: int = 2) -> DataFrame:
    return df.agg(F.max(column).alias("max_year")).withColumn("ok", F.coalesce(F.col("max_year") >= now_year - years, F.lit(False)))


def presence(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """(item, n): rows whose list column holds each value."""
    counted = df.agg(*[F.count_if(has_item(column, v)).alias(v) for v in values])
    entries = [F.struct(F.lit(v).alias("item"), F.col(f"`{v}`").alias("n")) for v in values]
    return counted.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def profile(df: DataFrame, table: str) -> DataFrame:
    """(table_name, column_name, data_type, rows, non_null, min, max, mean): one aggregate for all columns."""
    simple = [f for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    aggs = [F.count("*").alias("_rows")]
    for f in simple:
        c = F.col(f.name)
        mean = F.avg(c) if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        aggs.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.count(c).alias("non_null"),
            F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), mean.alias("mean"),
        ).alias(f"_s_{f.name}"))
    stats = df.agg(*aggs)
    listed = F.explode(F.array(*[F.col(f"_s_{f.name}") for f in simple])).alias("_e")
    return stats.select(F.lit(table).alias("table_name"), F.col("_rows").alias("rows"), listed).select("table_name", "rows", "_e.*")


def dq_report(log: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Per table over the last days: checks, failures and pass rate in percent."""
    recent = log.filter(F.col("logged_at") > now - F.make_dt_interval(days=F.lit(days)))
    return recent.groupBy("table_name").agg(
        F.count("*").alias("checks"), F.count_if(~F.col("passed")).alias("failures"), (100.0 * share(F.col("passed"))).alias("pass_rate")
    )


def check_split(df: DataFrame, key: str, year: str, split: str, train_until: int = 2014, val_until: int = 2018) -> DataFrame:
    """(rule, violations) of a labelled temporal split, duplicates of the key and empty splits included."""
    s, y = F.col(split), F.col(year)
    rules = {
        "unknown_label": ~s.isin("train", "val", "test"),
        "null_label": s.isNull() & y.isNotNull(),
        "label_without_year": s.isNotNull() & y.isNull(),
        "train_too_late": (s == "train") & (y > train_until),
        "val_outside": (s == "val") & ((y <= train_until) | (y > val_until)),
        "test_too_early": (s == "test") & (y <= val_until),
    }
    counted = df.agg(
        *[F.count_if(c).alias(n) for n, c in rules.items()],
        *[(F.count_if(s == name) == 0).cast("bigint").alias(f"empty_{name}") for name in ("train", "val", "test")],
    ).withColumn("duplicate_keys", duplicate_keys(df, [key]).scalar())
    entries = [F.struct(F.lit(c).alias("rule"), F.col(c).alias("violations")) for c in counted.columns]
    return counted.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
