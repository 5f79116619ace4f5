"""Models on Spark ML and the content predictor."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from marquee.functions.scalars import clamp
from marquee.operators.evaluate import reg_metrics
from marquee.operators.features import user_profiles
from marquee.operators.paging import union_all
from marquee.operators.prepare import Columns, chain, fit_preprocessor, vector_parts
from marquee.sources.files import collect_bounded
from marquee.session import shared_dir
from marquee.sources.sampling import key_sample

PIVOTS = 64  # at least
CHUNK_ROWS = 4096
BLOCK_ROWS = 1 << 16
MOST_NEWTON = 256  # values of a vector whose second derivatives are kept for each label


def rmse(df: DataFrame, y: str, p: str) -> float:
    return reg_metrics(df, y, p).first()["rmse"]


def baseline(train: DataFrame, y: str, name: str = "prediction") -> DataFrame:
    """One row: the train mean, which predicts everything."""
    return train.agg(F.avg(y).alias(name))


def with_baseline(df: DataFrame, train: DataFrame, y: str, name: str = "prediction") -> DataFrame:
    return df.withColumn(name, baseline(train, y, name).scalar())


def label_priors(train: DataFrame, items: str) -> DataFrame:
    """(label, prob): share of train rows with each label of an array column."""
    n = train.agg(F.count("*")).scalar()
    counted = train.select(F.explode(items).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    return counted.select("label", (F.col("n") / n).alias("prob"))


def positive_prob(name: str) -> Column:
    return vector_to_array(name)[1]


def side_by_side(spark: SparkSession, fit: Callable, cases: Sequence, threads: int = 4) -> list:
    """``fit`` of each case, in order; at most ``threads`` driver threads, which only submit jobs."""
    with ThreadPool(threads) as pool:
        return pool.map(inheritable_thread_target(spark)(fit), cases, chunksize=1)


def _summed(rows: DataFrame, labels: int, width: int, work: Callable) -> list[np.ndarray]:
    """Per label, the sum over all rows of the ``width`` numbers that ``work(x, y)`` gives for a batch, a row per label."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((labels, width))
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (0, 1))
                total += work(x.astype(float), y.astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(labels, dtype=np.int32)), pa.array([t.tobytes() for t in total])], names=["label", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in table.column("sums").to_pylist())
        return pa.table({"label": table.column("label").slice(0, 1), "sums": pa.array([total.tobytes()])})

    sums = rows.mapInArrow(part, "label int, sums binary").groupBy("label").applyInArrow(add, "label int, sums binary").collect()  # a row per label
    return [np.frombuffer(r["sums"]) for r in sorted(sums, key=lambda r: r["label"])]


def newton_ovr(train: DataFrame, items: str, labels: Sequence[str], balanced: bool, max_iter: int, penalty: float) -> dict[str, Model] | None:
    """Logistic models of all labels by Newton steps, each one pass over the rows for all of them; none if vectors are wide.

    The loss is that of Spark's learner: mean log loss, and half the penalty times the squares of the coefficients of features
    divided by their deviations. Steps that raise a label's loss are halved. A label that all rows or none have is certain.
    """
    x = vector_to_array("features").alias("x")
    y = F.array(*[F.coalesce(F.array_contains(items, label), F.lit(False)).cast("tinyint") for label in labels]).alias("y")
    rows = train.select(x, y)
    first = rows.first()
    if first is None or len(first["x"]) > MOST_NEWTON:
        return None
    k, d = len(labels), len(first["x"])

    def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = np.hstack([np.ones((len(x), 1)), x, x * x])
        return np.hstack([np.tile(both.sum(axis=0), (k, 1)), y.T @ both])

    sums = np.array(_summed(rows, k, 2 * (1 + 2 * d), moments)).reshape(k, 2, 1 + 2 * d)
    every, true = sums[:, 0], sums[:, 1]
    n, share = every[0, 0], true[:, 0] / every[0, 0]
    one, none = np.ones(k), np.ones(k)
    open_ = (share > 0) & (share < 1)
    if balanced:
        one[open_], none[open_] = 0.5 / share[open_], 0.5 / (1 - share[open_])
    weighted = one[:, None] * true + none[:, None] * (every - true)
    total, squares = weighted[:, 0], one**2 * true[:, 0] + none**2 * (n - true[:, 0])
    mean = weighted[:, 1 : d + 1] / total[:, None]
    spread = np.maximum(weighted[:, d + 1 :] / total[:, None] - mean**2, 0) * (total / np.maximum(total - squares / total, 1e-300))[:, None]
    sd = np.where(spread > 1e-14 * (1 + mean**2), np.sqrt(spread), 0)
    scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0)  # a feature without spread has no coefficient
    at = np.zeros((k, d + 1))
    odds = one * true[:, 0] / np.where(open_, none * (n - true[:, 0]), 1)
    at[:, d] = np.log(np.where(open_, odds, 1))
    places = np.tril_indices(d + 1)

    def derivatives(at: np.ndarray) -> Callable:
        def work(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.zeros((k, 1 + d + 1 + len(places[0])))
            for i in np.flatnonzero(open_):
                z = np.hstack([(x - mean[i]) * scale[i], np.ones((len(x), 1))])
                margin, w = z @ at[i], np.where(y[:, i] > 0, one[i], none[i])
                p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
                out[i, 0] = (w * (np.logaddexp(0, margin) - y[:, i] * margin)).sum()
                out[i, 1 : d + 2] = z.T @ (w * (p - y[:, i]))
                out[i, d + 2 :] = ((z * (w * p * (1 - p))[:, None]).T @ z)[places]
            return out

        return work

    ridge = np.full(d + 1, penalty)
    ridge[d] = 0
    loss, step, old = np.full(k, np.inf), np.zeros((k, d + 1)), at.copy()
    moving = open_.copy()
    for _ in range(max_iter):
        if not moving.any():
            break
        for i, sums in enumerate(_summed(rows, k, 1 + d + 1 + len(places[0]), derivatives(at))):
            if not moving[i]:
                continue
            now = sums[0] / total[i] + 0.5 * (ridge * at[i] ** 2).sum()
            if now > loss[i] + 1e-12 * (1 + abs(now)):
                step[i] /= 2
                at[i] = old[i] + step[i]
                moving[i] = np.abs(step[i]).max() > 1e-10
                continue
            gradient = sums[1 : d + 2] / total[i] + ridge * at[i]
            curve = np.zeros((d + 1, d + 1))
            curve[places] = sums[d + 2 :] / total[i]
            curve = curve + np.tril(curve, -1).T + np.diag(ridge)
            loss[i], old[i], step[i] = now, at[i], -np.linalg.lstsq(curve, gradient, rcond=None)[0]
            at[i] = old[i] + step[i]
            moving[i] = np.abs(step[i]).max() > 1e-8
    coefficients = at[:, :d] * scale
    intercepts = at[:, d] - (coefficients * mean).sum(axis=1)
    intercepts = np.where(open_, intercepts, np.where(share > 0, np.inf, -np.inf))
    context = train.sparkSession.sparkContext

    def model(i: int) -> Model:
        weights = _py2java(context, Vectors.dense(coefficients[i]))
        made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"logistic_{uuid.uuid4().hex[:12]}", weights, float(intercepts[i]))
        return LogisticRegressionModel(made)

    return {label: model(i) for i, label in enumerate(labels)}


def fit_ovr(train: DataFrame, items: str, labels: Sequence[str], balanced: bool = False, max_iter: int = 1000) -> dict[str, Model]:
    """One logistic model per label of an array column; labels may co-occur, so they are independent models.

    ``balanced`` weighs both classes equally. The caller caches ``train``. Vectors of up to ``MOST_NEWTON`` values are fitted for
    all labels together, wider ones label by label.
    """
    together = newton_ovr(train, items, labels, balanced, max_iter, 0.01) if labels else {}
    if together is not None:
        return together

    def fit(label: str) -> Model:
        data = train.withColumn("_y", F.coalesce(F.array_contains(items, label), F.lit(False)).cast("double"))
        learner = LogisticRegression(featuresCol="features", labelCol="_y", maxIter=max_iter, regParam=0.01)
        if balanced:
            positive = data.agg(F.avg("_y")).scalar()
            weight = F.when(F.col("_y") == 1, 0.5 / F.nullif(F.col("_share"), F.lit(0.0))).otherwise(0.5 / F.nullif(1 - F.col("_share"), F.lit(0.0)))
            data = data.withColumn("_share", positive).withColumn("_w", F.coalesce(weight, F.lit(1.0)))
            learner = learner.setWeightCol("_w")
        return learner.fit(data)

    return dict(zip(labels, side_by_side(train.sparkSession, fit, labels)))


def score_labels(df: DataFrame, models: Mapping[str, Model], key: str, items: str) -> DataFrame:
    """(key, label, y, prob) for each model."""
    scored = df
    for i, model in enumerate(models.values()):
        named = model.copy().setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_c{i}")
        scored = named.transform(scored).drop(f"_r{i}", f"_c{i}")
    entries = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.coalesce(F.array_contains(items, label), F.lit(False)).cast("int").alias("y"),
            positive_prob(f"_p{i}").alias("prob"),
        )
        for i, label in enumerate(models)
    ])
    return scored.select(key, F.explode(entries).alias("_e")).select(key, "_e.*")


def ridge(train: DataFrame, alphas: Sequence[float], y: str) -> list[Model]:
    """A linear model per alpha, a penalty on the squared coefficients beside the sum of squared errors.

    Columns are taken as they are; standardise them before. The library's penalty stands beside the mean of squared errors
    and is divided by the label's deviation, so both are put back in.
    """
    size = train.agg(F.count(y).alias("n"), F.stddev_pop(y).alias("sd")).first()
    scale = (size["sd"] or 1.0) / max(size["n"], 1)
    learner = LinearRegression(featuresCol="features", labelCol=y, elasticNetParam=0.0, standardization=False, solver="normal")
    return [learner.setRegParam(alpha * scale).fit(train) for alpha in alphas]


def fit_ridge(train: DataFrame, val: DataFrame, y: str, alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0)) -> tuple[Model, float]:
    """(model, alpha) with the lowest validation error. The caller caches both inputs."""
    fits = [(rmse(model.transform(val), y, "prediction"), alpha, model) for alpha, model in zip(alphas, ridge(train, alphas, y))]
    _, alpha, model = min(fits, key=lambda f: f[:2])
    return model, alpha


def fit_gbt(
    train: DataFrame, val: DataFrame, y: str, grid: Sequence[Mapping[str, float]] = ({"maxDepth": 3}, {"maxDepth": 5}), rounds: int = 300
) -> tuple[Model, Mapping[str, float]]:
    """(model, settings): boosted trees that stop early on the validation rows; best of a small grid."""
    data = train.withColumn("_val", F.lit(False)).unionByName(val.withColumn("_val", F.lit(True)))
    fits = []
    for i, settings in enumerate(grid):
        learner = GBTRegressor(
            featuresCol="features", labelCol=y, maxIter=rounds, validationIndicatorCol="_val", seed=42, **settings
        )
        model = learner.fit(data)
        fits.append((rmse(model.transform(val), y, "prediction"), i, model, settings))
    _, _, model, settings = min(fits, key=lambda f: f[:2])
    return model, settings


def validation_years(df: DataFrame, year: str) -> list[int]:
    """Every year with earlier rows."""
    return sorted(collect_bounded(df.select(year).where(F.col(year).isNotNull()).distinct(), 1000)[year].tolist())[1:]


def nested_folds(
    df: DataFrame, year: str, y: str, grid: Sequence[Mapping[str, float]] = ({"maxDepth": 3}, {"maxDepth": 5}), rounds: int = 300, threads: int = 4,
) -> list[tuple[int, DataFrame, Mapping[str, float]]]:
    """(year, its rows with predictions, settings) for every year with earlier rows.

    Settings and the number of trees are chosen on the latest earlier year, by models of the years before that; the model
    that scores is then fitted on all earlier years. The scored year takes no part in either. Without a year to choose on,
    the first settings and ``rounds`` trees are taken. Years are fitted side by side by at most ``threads`` driver threads, which
    only submit jobs. The caller caches ``df``.
    """
    years = validation_years(df, year)

    def fold(at: int) -> tuple[int, DataFrame, Mapping[str, float]]:
        earlier, own = df.filter(F.col(year) < years[at]), df.filter(F.col(year) == years[at])
        settings, trees = dict(grid[0]), rounds
        if at:
            chosen, settings = fit_gbt(df.filter(F.col(year) < years[at - 1]), df.filter(F.col(year) == years[at - 1]), y, grid, rounds)
            trees = chosen.getNumTrees
        model = GBTRegressor(featuresCol="features", labelCol=y, maxIter=trees, seed=42, **settings).fit(earlier)
        return years[at], model.transform(own), {**settings, "trees": trees}

    return side_by_side(df.sparkSession, fold, range(len(years)), threads)


def fit_als(train: DataFrame, rank: int = 50, iterations: int = 20, user: str = "user_idx", item: str = "item_idx") -> Model:
    """Matrix factorisation. Unknown users and items score NaN; see :func:`als_scores`.

    Factors are checkpointed in every iteration, which drops the shuffle files of the one before; without a folder for that
    all iterations would stay on disk.
    """
    shared_dir(train.sparkSession)
    ints = train.select(F.col(user).cast("int"), F.col(item).cast("int"), F.col("rating").cast("float"))
    learner = ALS(rank=rank, maxIter=iterations, userCol=user, itemCol=item, ratingCol="rating", coldStartStrategy="nan", checkpointInterval=1, seed=42)
    return learner.fit(ints)


def als_scores(model: Model, df: DataFrame, train: DataFrame, name: str = "als_score") -> DataFrame:
    """Scores on the 1 to 10 scale, the train mean where a user or item is unknown."""
    scored = model.setPredictionCol("_als").transform(df)
    mean = train.agg(F.avg("rating")).scalar()
    known = F.nanvl(F.col("_als").cast("double"), F.lit(None).cast("double"))
    return scored.withColumn("_mean", mean).withColumn(name, clamp(F.coalesce(known, "_mean"), 1.0, 10.0)).drop("_als", "_mean")


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda acc, x: acc + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def hybrid_scores(df: DataFrame, als: DataFrame, train: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Add ``content_score``, the cosine of user profile and item, to rows with ``als_score``.

    Users without liked items and items without an embedding use the mean embedding.
    """
    from pyspark.ml.stat import Summarizer

    vectors = embeddings.select(F.col("item_id"), F.col("embedding").cast("array<double>").alias("_item"))
    mean = vectors.agg(vector_to_array(Summarizer.mean(array_to_vector("_item")))).scalar()
    profiles = user_profiles(train, embeddings)
    joined = als.join(profiles, "user_id", "left").join(vectors, "item_id", "left").withColumn("_mean", mean)
    score = cosine(F.coalesce("profile", "_mean"), F.coalesce("_item", "_mean"))
    return joined.withColumn("content_score", score).drop("profile", "_item", "_mean")


def fit_hybrid(val: DataFrame, threshold: float = 7.0) -> Model:
    """Logistic model of "liked" on the two standardised scores."""
    data = val.withColumn("_y", (F.col("rating") >= threshold).cast("double"))
    return Pipeline(stages=[
        VectorAssembler(inputCols=["als_score", "content_score"], outputCol="_scores"),
        StandardScaler(inputCol="_scores", outputCol="_scaled", withMean=True),
        LogisticRegression(featuresCol="_scaled", labelCol="_y", probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred"),
    ]).fit(data)


def predict_hybrid(model: Model, df: DataFrame, name: str = "score") -> DataFrame:
    scored = model.transform(df).withColumn(name, positive_prob("_prob"))
    return scored.drop("_scores", "_scaled", "_prob", "_raw", "_pred")


def stack_models(
    val: DataFrame, test: DataFrame, scores: Sequence[str], y: str, kind: str = "linear", name: str = "stacked"
) -> DataFrame:
    """Test rows with the score of a meta model fitted on the base models' validation scores."""
    assembler = VectorAssembler(inputCols=list(scores), outputCol="_stack")
    if kind == "linear":
        learner = LinearRegression(featuresCol="_stack", labelCol=y, regParam=1.0, elasticNetParam=0.0, predictionCol=name)
        return Pipeline(stages=[assembler, learner]).fit(val).transform(test).drop("_stack")
    learner = LogisticRegression(featuresCol="_stack", labelCol=y, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
    scored = Pipeline(stages=[assembler, learner]).fit(val).transform(test)
    return scored.withColumn(name, positive_prob("_prob")).drop("_stack", "_prob", "_raw", "_pred")


def ablation(
    train: DataFrame, test: DataFrame, columns: Columns, groups: Mapping[str, Sequence[str]], fit: Callable[[DataFrame], Model], y: str
) -> DataFrame:
    """(variant, rmse): all columns, then each group left out.

    What a preprocessor learns of a column does not depend on the others, so columns are learned and prepared once, and every
    variant puts its own vector together and has its own model.
    """
    variants = {"all": columns} | {f"without_{g}": columns.without(names) for g, names in groups.items()}
    learned = chain(*fit_preprocessor(train, columns).stages[:-1])
    made = [learned.transform(df).select(*[F.col(f"`{c}`") for c in df.columns], *vector_parts(columns)).persist() for df in (train, test)]
    found = []
    try:
        for name, kept in variants.items():
            whole = VectorAssembler(inputCols=vector_parts(kept), outputCol="features")
            own, other = (whole.transform(df).drop(*vector_parts(columns)) for df in made)
            found.append((name, rmse(fit(own).transform(other), y, "prediction")))
    finally:
        for df in made:
            df.unpersist()
    return train.sparkSession.createDataFrame(found, "variant string, rmse double")


def learning_curve(
    train: DataFrame, test: DataFrame, fit: Callable[[DataFrame], Model], y: str, key: str, percents: Sequence[int] = (20, 50, 80, 100)
) -> DataFrame:
    """(percent, rmse) for models fitted on growing, nested parts of the train rows."""
    parts = []
    for percent in percents:
        model = fit(key_sample(train, key, percent))
        parts.append(reg_metrics(model.transform(test), y, "prediction").select(F.lit(percent).alias("percent"), "rmse"))
    return union_all(parts)


def score(df: DataFrame, model: Model, low: float = 1.0, high: float = 10.0, name: str = "prediction") -> DataFrame:
    """Batch predictions, kept to the rating scale."""
    return model.transform(df).withColumn(name, clamp(F.col("prediction"), low, high))


# Nearest item by cosine, exactly and without comparing everything with everything where vectors cluster.


def _unit(vectors: pd.Series) -> np.ndarray:
    matrix = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1.0, 1.0))


def _open(angles: np.ndarray, low: np.ndarray, high: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Which groups may hold something at least as near as ``best``: by the triangle inequality on the sphere nothing in a
    group is nearer than its ring allows."""
    bound = np.maximum(angles - high, low - angles)
    return bound <= np.arccos(np.clip(best, -1.0, 1.0))[:, None] + 1e-6


def _types(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _with_cell(df: DataFrame, vec: str, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot as ``cell`` and the ``angle`` to it."""
    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                angles = _angles(_unit(frame[vec]), pivots)
                cell = angles.argmin(axis=1)
                yield frame.assign(cell=cell.astype("int32"), angle=angles[np.arange(len(cell)), cell])

    return df.mapInPandas(assign, f"{_types(df, *df.columns)}, cell int, angle double")


def _in_blocks(left: DataFrame, right: DataFrame, on: Sequence[str], key: str, fn: Callable, schema: str, rows: int) -> DataFrame:
    """``fn`` of the rows of both sides that share ``on``; a large left group comes in blocks of about ``rows``, each with
    all of the right group."""
    on = list(on)
    counts = left.groupBy(*on).agg(F.ceil(F.count("*") / rows).cast("int").alias("_blocks"))
    own = left.join(counts, on).withColumn("_block", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")).drop("_blocks")
    every = right.join(counts, on).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    every = every.select(*[F.col(c).alias(c) for c in every.columns])  # both sides may come from one table
    return own.groupBy(*on, "_block").cogroup(every.groupBy(*on, "_block")).applyInPandas(fn, schema)


def _pieces(n: int) -> Iterator[slice]:
    return (slice(start, start + CHUNK_ROWS) for start in range(0, n, CHUNK_ROWS))


def _fine_cells(placed: DataFrame, item: str, vec: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Items with a second pivot of their cell as ``fine``, and those groups (cell, fine, pivot, lo, hi, n).

    About one item in ``CHUNK_ROWS`` is a pivot, by its digest, and the first of each cell, so groups stay small as cells grow.
    """
    digest = F.xxhash64(F.col(item))
    first = placed.groupBy("cell").agg(F.min_by(item, F.struct(digest, F.col(item))).alias(item))
    picked = placed.filter(F.pmod(digest, F.lit(CHUNK_ROWS)) == 0).select("cell", item).unionAll(first.select("cell", item)).distinct()
    pivots = placed.join(picked, ["cell", item], "left_semi").select("cell", F.col(item).cast("long").alias("fine"), F.col(vec).alias("pivot"))
    kind = _types(placed, item, vec, value)

    def assign(rows: pd.DataFrame, fine: pd.DataFrame) -> pd.DataFrame:
        fine = fine.sort_values("fine")
        units, ids, out = _unit(fine["pivot"]), fine["fine"].to_numpy(), []
        for part in _pieces(len(rows)):
            angles = _angles(_unit(rows[vec].iloc[part]), units)
            nearest = angles.argmin(axis=1)
            out.append(rows[[item, vec, value, "cell"]].iloc[part].assign(fine=ids[nearest], angle=angles[np.arange(len(nearest)), nearest]))
        return pd.concat(out) if out else rows.assign(fine=np.zeros(0, "int64"))[[item, vec, value, "cell", "fine", "angle"]]

    fine = _in_blocks(placed, pivots, ["cell"], item, assign, f"{kind}, cell int, fine long, angle double", BLOCK_ROWS)
    groups = fine.groupBy("cell", "fine").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n"))
    return fine.drop("angle"), groups.join(pivots, ["cell", "fine"])


def _routes(queries: DataFrame, key: str, vec: str, pivots: np.ndarray, rings: Mapping[int, tuple[float, float]], home: bool) -> DataFrame:
    """``queries`` with ``cell``: the nearest one, or all that may hold something better than ``best``."""
    cells = np.array(sorted(rings), dtype="int32")
    low, high = (np.array([rings[c][side] for c in cells.tolist()]) for side in (0, 1))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in _pieces(len(frame)):
                rows = frame.iloc[part]
                angles = _angles(_unit(rows[vec]), pivots[cells])
                if home:
                    yield rows.assign(cell=cells[angles.argmin(axis=1)])
                else:
                    row, col = np.nonzero(_open(angles, low, high, rows["best"].to_numpy()))
                    yield rows.iloc[row].assign(cell=cells[col])

    return queries.mapInPandas(route, f"{_types(queries, *queries.columns)}, cell int")


def _fine_routes(queries: DataFrame, groups: DataFrame, key: str, vec: str, home: bool) -> DataFrame:
    """``queries`` (with their cell) with ``fine``: the nearest group of the cell, or all others that may hold something better."""
    names = [*queries.columns, "fine"]

    def route(rows: pd.DataFrame, fine: pd.DataFrame) -> pd.DataFrame:
        fine = fine.sort_values("fine")
        units, ids, out = _unit(fine["pivot"]), fine["fine"].to_numpy(), [rows.iloc[:0].assign(fine=np.zeros(0, "int64"))]
        for part in _pieces(len(rows)) if len(fine) else ():
            some = rows.iloc[part]
            angles = _angles(_unit(some[vec]), units)
            if home:
                out.append(some.assign(fine=ids[angles.argmin(axis=1)]))
                continue
            near = _open(angles, fine["lo"].to_numpy(), fine["hi"].to_numpy(), some["best"].to_numpy())
            near &= (some["home_cell"].to_numpy() != some["cell"].to_numpy())[:, None] | (some["home_fine"].to_numpy()[:, None] != ids)
            row, col = np.nonzero(near)
            out.append(some.iloc[row].assign(fine=ids[col]))
        return pd.concat(out)[names]

    return _in_blocks(queries, groups, ["cell"], key, route, f"{_types(queries, *queries.columns)}, fine long", BLOCK_ROWS)


def _best_in_groups(routed: DataFrame, items: DataFrame, groups: DataFrame, key: str, item: str, vec: str, value: str) -> DataFrame:
    """Best item per routed query. Large groups are cut into chunks and large query sets into blocks, so a task compares at
    most a block with a chunk; each comparison is one matrix product."""
    on = ["cell", "fine"]
    chunks = groups.select(*on, F.ceil(F.col("n") / CHUNK_ROWS).cast("int").alias("_chunks"))
    left = routed.select(key, vec, *on).join(chunks, on).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    right = items.join(chunks, on).withColumn("chunk", F.pmod(F.xxhash64(item), F.col("_chunks")).cast("int"))
    right = right.select(item, F.col(vec).alias("_vec"), value, *on, "chunk")

    def compare(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(members):
            return pd.DataFrame({key: queries[key][:0], "best": np.zeros(0), item: members[item][:0], value: members[value][:0]})
        members = members.sort_values(item)
        similarity = np.round(_unit(queries[vec]) @ _unit(members["_vec"]).T, 12)
        pick = similarity.argmax(axis=1)
        return pd.DataFrame({
            key: queries[key].to_numpy(), "best": similarity[np.arange(len(pick)), pick],
            item: members[item].to_numpy()[pick], value: members[value].to_numpy()[pick],
        })

    shape = f"{_types(routed, key)}, best double, {_types(items, item, value)}"
    found = _in_blocks(left.drop("_chunks"), right, [*on, "chunk"], key, compare, shape, CHUNK_ROWS)
    return _best(found, key, item, value)


def _best(found: DataFrame, key: str, item: str, value: str) -> DataFrame:
    top = F.max_by(F.struct("best", item, value), F.struct(F.col("best"), -F.col(item))).alias("_t")
    return found.groupBy(key).agg(top).select(key, "_t.*")


def pivot_count(n: int) -> int:
    """First pivots for ``n`` items: the square root of the chunks they fill, so that a cell has as many second pivots."""
    return max(1, min(n, max(PIVOTS, math.isqrt(-(-n // CHUNK_ROWS)))))


def nearest_item(queries: DataFrame, items: DataFrame, key: str, item: str, vec: str, value: str) -> DataFrame:
    """(key, best, item, value): for each query the item with the largest cosine, the smallest id among equals.

    Items are grouped around some of their own vectors. The best match in a query's home group bounds the angle; another
    group is searched only if it can hold a smaller one. Beyond ``PIVOTS`` chunks of items the groups have two levels: first
    pivots go to every task and grow with the square root of the items, second ones only meet the rows of their cell, and a
    group stays about a chunk large. The result is exact for any data; where vectors cluster, a query meets a number of
    groups that does not grow with the items. ``item`` ids are numbers.
    """
    items = items.select(item, vec, value)
    n = items.count()
    sample = items.orderBy(F.xxhash64(item), item).limit(pivot_count(n)).select(vec).collect()  # pivot_count vectors
    if not sample:
        return _best(queries.limit(0).select(key, F.lit(0.0).alias("best")).join(items.limit(0), F.lit(True)), key, item, value)
    pivots = _unit(pd.Series([r[0] for r in sample]))
    placed = _with_cell(items, vec, pivots)
    stats = placed.groupBy("cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n"))
    rings = {r["cell"]: (r["lo"], r["hi"], r["n"]) for r in stats.collect()}  # pivot_count rows
    queries = queries.select(key, vec)
    at_home = _routes(queries, key, vec, pivots, rings, home=True)
    if n > PIVOTS * CHUNK_ROWS:
        members, groups = _fine_cells(placed, item, vec, value)
        # The groups are read by every step that follows.
        shared_dir(items.sparkSession)
        members, groups = members.checkpoint(), groups.checkpoint()
        at_home = _fine_routes(at_home, groups, key, vec, home=True)
    else:
        members = placed.select(item, vec, value, "cell", F.lit(0).cast("long").alias("fine"))
        groups = items.sparkSession.createDataFrame([(c, 0, size) for c, (_, _, size) in rings.items()], "cell int, fine long, n long")
        at_home = at_home.withColumn("fine", F.lit(0).cast("long"))
    first = _best_in_groups(at_home, members, groups, key, item, vec, value)
    bounded = at_home.withColumnsRenamed({"cell": "home_cell", "fine": "home_fine"}).join(first.select(key, "best"), key)
    others = _routes(bounded, key, vec, pivots, rings, home=False)
    if n > PIVOTS * CHUNK_ROWS:
        others = _fine_routes(others, groups, key, vec, home=False)
    else:
        others = others.filter("cell <> home_cell").withColumn("fine", F.lit(0).cast("long"))
    second = _best_in_groups(others, members, groups, key, item, vec, value)
    return _best(first.unionByName(second), key, item, value)
