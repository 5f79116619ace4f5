"""Evaluation of predictions: metrics, gates and comparisons, as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.scalars import split_list
from marquee.operators.ordering import exact_quantiles, top_per_group


# The release gates.
QUALITY_GATES = {
    "G1_rating_rmse": ("test_rmse", "<=", 0.55),
    "G2_genre_macro_f1": ("test_macro_f1", ">", 0.60),
    "G3_temporal_generalization": ("val_test_delta", "<", 0.10),
    "G4_mlflow_naming": ("naming_compliant", "==", 1.0),
    "G5_inference_latency": ("p95_latency_ms", "<", 100.0),
    "G6_artifacts_exist": ("all_artifacts_present", "==", 1.0),
}
MAX_SINGLE_IMPORTANCE = 0.80


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def multilabel_metrics(
    pairs: DataFrame, keys: DataFrame, key: str = "key", label: str = "label", threshold: float = 0.5, labels: DataFrame | None = None
) -> DataFrame:
    """One row of multi-label metrics.

    ``pairs`` has (key, label, y, prob) for every pair that is true or scored; other pairs are true
    negatives and need no rows. ``keys`` has one row per example. A label is predicted above the threshold.
    """
    pred, true = F.col("prob") > threshold, F.col("y") == 1
    marked = pairs.select(
        key, label, (true & pred).cast("long").alias("tp"), (~true & pred).cast("long").alias("fp"), (true & ~pred).cast("long").alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    per_label = marked.groupBy(label).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    if labels is not None:
        per_label = labels.select(label).join(per_label, label, "left").fillna(0)
    out = per_label.agg(
        F.avg(f1(tp, fp, fn)).alias("macro_f1"),
        f1(F.sum(tp), F.sum(fp), F.sum(fn)).alias("micro_f1"),
        F.avg(ratio(tp, tp + fp)).alias("macro_precision"),
        F.avg(ratio(tp, tp + fn)).alias("macro_recall"),
        F.sum(fp + fn).alias("_wrong"), F.count("*").alias("_labels"),
    )
    total = keys.agg(F.count("*")).scalar()
    flawed = marked.filter((fp == 1) | (fn == 1)).agg(F.count_distinct(key)).scalar()
    return out.select(
        "macro_f1", "micro_f1", "macro_precision", "macro_recall",
        (F.col("_wrong") / (F.col("_labels") * total)).alias("hamming_loss"), (1 - flawed / total).alias("subset_accuracy"),
    )


def reg_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """rmse, mae and r2, per group if keys are given, in one aggregate."""
    error = F.col(p) - F.col(y)
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (1 - F.avg(error * error) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
    )


def q_error(df: DataFrame, y: str, p: str, percentiles: Sequence[int] = (50, 90, 95, 99)) -> DataFrame:
    """One row: percentiles of max(p/y, y/p); rows where that is infinite or undefined are left out."""
    truth, guess = F.col(y).cast("double"), F.col(p).cast("double")
    worst = F.greatest(guess / F.nullif(truth, F.lit(0.0)), truth / F.nullif(guess, F.lit(0.0)))
    ratios = df.filter((truth != 0) & (guess != 0)).select(worst.alias("ratio"))
    found = exact_quantiles(ratios, "ratio", [x / 100 for x in percentiles])
    return found.select(*[F.col(f"q{i}").alias(f"q_error_p{x}") for i, x in enumerate(percentiles)])


def precision_recall_at_k(
    df: DataFrame, user: str, score: str, rating: str, tie: str, k: int = 10, threshold: float = 7.0
) -> DataFrame:
    """One row: precision (divided by k) and recall of the k best scores, averaged over users."""
    hits = top_per_group(df.select(user, score, rating, tie), [user], [F.desc(score), F.asc(tie)], k)
    hits = hits.groupBy(user).agg(F.count_if(F.col(rating) >= threshold).alias("hits"))
    relevant = df.groupBy(user).agg(F.count_if(F.col(rating) >= threshold).alias("relevant"))
    return relevant.join(hits, user).agg(
        F.avg(F.col("hits") / k).alias("precision_at_k"), F.avg(ratio(F.col("hits"), F.col("relevant"))).alias("recall_at_k")
    )


def cold_start(train: DataFrame, test: DataFrame, user: str, n: int = 5, include_unseen: bool = False) -> DataFrame:
    """Test rows of users with fewer than ``n`` train rows; users without any count only if asked for."""
    counts = train.groupBy(user).agg(F.count("*").alias("_n"))
    if include_unseen:
        return test.join(counts.filter(F.col("_n") >= n), user, "left_anti")
    return test.join(counts.filter(F.col("_n") < n), user, "left_semi")


def evaluate_gates(metrics: DataFrame, gates: Mapping[str, tuple[str, str, float]] = QUALITY_GATES) -> DataFrame:
    """(gate, metric, op, threshold, value, passed) for metrics (metric, value); a missing metric fails."""
    spark = metrics.sparkSession
    rules = spark.createDataFrame(
        [(g, m, op, float(t)) for g, (m, op, t) in gates.items()], "gate string, metric string, op string, threshold double"
    )
    joined = rules.join(metrics.select("metric", "value"), "metric", "left")
    v, t, op = F.col("value"), F.col("threshold"), F.col("op")
    verdict = F.when(op == "<", v < t).when(op == "<=", v <= t).when(op == ">", v > t).when(op == ">=", v >= t).when(op == "==", v == t)
    return joined.withColumn("passed", F.coalesce(verdict, F.lit(False)))


def feature_audit(importances: DataFrame, limit: float = MAX_SINGLE_IMPORTANCE) -> DataFrame:
    """(feature, importance, passed): share of each feature; one above the limit hints at a leaked target."""
    total = importances.agg(F.sum("importance")).scalar()
    share = F.col("importance") / F.coalesce(F.nullif(total, F.lit(0.0)), F.lit(1.0))
    return importances.select("feature", share.alias("importance")).withColumn("passed", F.col("importance") <= limit)


def temporal_decay(metrics: DataFrame) -> DataFrame:
    """(name, val, test, delta) from (name, metric, value): macro F1 where a model has it, else RMSE."""
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    per_model = metrics.groupBy("name").agg(
        F.coalesce(F.nullif(value("val_macro_f1"), F.lit(0.0)), value("val_rmse")).alias("val"),
        F.coalesce(F.nullif(value("test_macro_f1"), F.lit(0.0)), value("test_rmse")).alias("test"),
    )
    return per_model.filter("val IS NOT NULL AND test IS NOT NULL").withColumn("delta", F.col("test") - F.col("val"))


def label_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.explode(split_list(column)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def split_year_ranges(df: DataFrame, split: str = "split", year: str = "start_year") -> DataFrame:
    """Rows and first, last and median year of each split; years are few, so the median is cheap."""
    return df.groupBy(split).agg(
        F.min(year).alias("min_year"), F.max(year).alias("max_year"), F.median(year).alias("median_year"), F.count("*").alias("n")
    )


def rank_models(metrics: DataFrame, pillars: Mapping[str, bool]) -> DataFrame:
    """(name, <pillar>..., overall) from (name, pillar, value).

    Values are min-max scaled within a pillar (``pillars`` says whether higher is better); a pillar a
    model lacks counts 0; the overall score is their mean.
    """
    bounds = metrics.groupBy("pillar").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = F.col("hi") - F.col("lo")
    scaled = (F.col("value") - F.col("lo")) / F.when(span > 0, span).otherwise(1.0)
    lower = [p for p, higher in pillars.items() if not higher]
    scored = metrics.join(bounds, "pillar").withColumn("score", F.when(F.col("pillar").isin(lower), 1 - scaled).otherwise(scaled))
    wide = scored.groupBy("name").pivot("pillar", list(pillars)).agg(F.max("score")).fillna(0.0)
    total = sum((F.col(p) for p in pillars), F.lit(0.0))
    return wide.withColumn("overall", total / len(pillars))


def promote_ok(new: DataFrame, production: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """(model, new_value, prod_value, promote): blocked if the new value is worse by more than the tolerance.

    Both have (model, value, higher_is_better); without a value on one side nothing is blocked.
    """
    joined = new.select("model", F.col("value").alias("new_value"), "higher_is_better").join(
        production.select("model", F.col("value").alias("prod_value")), "model", "left"
    )
    worse = F.when(F.col("higher_is_better"), F.col("new_value") < F.col("prod_value") * (1 - tolerance)).otherwise(
        F.col("new_value") > F.col("prod_value") * (1 + tolerance)
    )
    return joined.withColumn("promote", ~F.coalesce(worse, F.lit(False))).drop("higher_is_better")


def tune_thresholds(scores: DataFrame, label: str = "label", y: str = "y", prob: str = "prob") -> DataFrame:
    """(label, threshold, f1): the threshold of 0.10, 0.15 ... 0.90 with the best F1, the lowest among equals.

    A label that no threshold finds gets 0.5. Scores are first counted per (label, class, number of thresholds
    reached), at most 36 rows per label, and only those meet the thresholds.
    """
    steps = [x / 20 for x in range(2, 19)]
    reached = sum((F.when(F.col(prob) >= t, 1).otherwise(0) for t in steps), F.lit(0))
    counts = scores.groupBy(label, F.col(y).cast("int").alias("_y"), reached.alias("_r")).agg(F.count("*").alias("_n"))
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(steps)])).alias("_s")
    spread = counts.select(label, "_y", "_r", "_n", grid)
    hit, true = F.col("_r") > F.col("_s.i"), F.col("_y") == 1
    count = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    scored = spread.groupBy(label, F.col("_s.t").alias("threshold")).agg(f1(count(hit & true), count(hit & ~true), count(~hit & true)).alias("f1"))
    best = top_per_group(scored, [label], [F.desc("f1"), F.asc("threshold")], 1).drop("_rank")
    return best.withColumn("threshold", F.when(F.col("f1") > 0, F.col("threshold")).otherwise(F.lit(0.5)))


def stack_metrics(df: DataFrame, name: str) -> DataFrame:
    """A one-row metric table as (name, metric, value)."""
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
    return df.select(F.lit(name).alias("name"), F.explode(entries).alias("_e")).select("name", "_e.*")
