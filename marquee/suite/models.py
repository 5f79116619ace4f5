"""Models on the bound tables. Training frames are cached while several fits read them."""

from contextlib import contextmanager

from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from marquee.functions.scalars import split_list
from marquee.operators import evaluate as ev
from marquee.operators import features as ft
from marquee.operators import models as md
from marquee.operators.paging import union_all
from marquee.operators.prepare import Columns, chain, fit_preprocessor, load, prepare, save
from marquee.sources.files import collect_bounded
from marquee.suite.core import query
from marquee.suite.evaluate import RATED_SQL, rated
from marquee.suite.features import inter, item_embeddings

GROUPS = {
    "title": ["start_year", "runtime_minutes", "genre_cnt", "is_adult"],
    "crew": ["num_persons", "unique_persons", "actor_count", "director_count", "writer_count"],
    "career": ["dir_avg_career_len", "dir_avg_experience", "wri_avg_career_len", "wri_avg_experience"],
    "category": ["title_type"],
    "lists": ["genre_list", "region_list"],
    "text": ["primary_title"],
}
NUMERIC = [c for g in ("title", "crew", "career") for c in GROUPS[g]]
FEATURES = Columns(numeric=NUMERIC, categorical=GROUPS["category"], lists=GROUPS["lists"], texts=GROUPS["text"])
# The labels are the genres, so nothing made of them may be a feature.
LABEL_FEATURES = FEATURES.without(["genre_list", "genre_cnt"])
# The five labels of the binary models.
BINARY_LABELS = ["Drama", "Comedy", "Action", "Thriller", "Romance"]


def report(df):
    """A small result, computed now, so that cached inputs can be released."""
    return df.sparkSession.createDataFrame(collect_bounded(df, 1000), df.schema)


@contextmanager
def cached(*dfs):
    kept = [df.persist() for df in dfs]
    try:
        yield kept
    finally:
        for df in kept:
            df.unpersist()


def frame(s):
    """Modelled titles: raw feature columns, rating, genres, split."""
    base = ft.base_features(s.dim_title, s.fact_performance, s.fact_episode).join(
        ft.crew_features(s.fact_performance, s.dim_title), "tconst", "left"
    )
    raw = base.select(
        "tconst", F.col("average_rating").alias("y"), F.coalesce(split_list("genre_list"), F.array().cast("array<string>")).alias("genres"),
        ft.temporal_split("start_year").alias("split"), *[F.col(c).cast("double").alias(c) for c in NUMERIC],
        *[c for g in ("category", "lists", "text") for c in GROUPS[g]],
    )
    return raw.filter("y IS NOT NULL")


def fit_on(rows, columns=FEATURES):
    """The preprocessor fitted on the train rows of a frame."""
    return fit_preprocessor(rows.filter("split = 'train'"), columns)


@contextmanager
def assembled(s, columns=FEATURES):
    """The frame with its vectors, cached. The raw frame is only kept while it is fitted and prepared."""
    with cached(frame(s)) as (rows,):
        data = prepare(fit_on(rows, columns), rows).persist()
        data.count()
    try:
        yield data
    finally:
        data.unpersist()


def parts(df):
    return [df.filter(F.col("split") == name) for name in ("train", "val", "test")]


def linear(train):
    return LinearRegression(featuresCol="features", labelCol="y", regParam=0.1).fit(train)


def error(df, name, y="y", p="prediction"):
    return ev.reg_metrics(df, y, p).select(F.lit(name).alias("model"), "rmse", "mae", "r2")


@query("k01_baseline", f"""
WITH {RATED_SQL}, m AS (SELECT avg(y) AS p FROM r WHERE start_year <= 2014)
SELECT tconst, round(m.p, 8) AS prediction FROM r, m WHERE start_year > 2014""")
def k01(s):
    rows = rated(s)
    scored = md.with_baseline(rows.filter("split <> 'train'"), rows.filter("split = 'train'"), "y")
    return scored.select("tconst", F.round("prediction", 8).alias("prediction"))


@query("k01_label_priors", """
SELECT label, round(count(*) / (SELECT count(*) FROM dim_title WHERE start_year <= 2014), 8) AS prob
FROM (SELECT unnest(string_split(genre_list, ', ')) AS label FROM dim_title WHERE start_year <= 2014) GROUP BY label""")
def k01_priors(s):
    train = s.dim_title.filter("start_year <= 2014").select(split_list("genre_list").alias("genres"))
    return md.label_priors(train, "genres").withColumn("prob", F.round("prob", 8))


def labels_of(train):
    """Every label of the training rows; genres are a short fixed vocabulary."""
    return sorted(collect_bounded(train.select(F.explode("genres").alias("label")).distinct(), 1000)["label"])


def label_report(s, balanced, labels=None):
    with assembled(s, LABEL_FEATURES) as data:
        train, val, test = parts(data)
        models = md.fit_ovr(train, "genres", labels or labels_of(train), balanced=balanced)
        best = ev.tune_thresholds(md.score_labels(val, models, "tconst", "genres"))
        scored = md.score_labels(test, models, "tconst", "genres").join(best.select("label", "threshold"), "label")
        hit, true = F.col("prob") >= F.col("threshold"), F.col("y") == 1
        per_label = scored.groupBy("label").agg(
            F.max("threshold").alias("threshold"), F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"),
            F.count_if(~hit & true).alias("fn"),
        )
        return report(per_label.withColumn("f1", ev.f1(F.col("tp"), F.col("fp"), F.col("fn"))))


@query("k02_one_vs_rest")
def k02(s):
    return label_report(s, balanced=False)


@query("k03_ridge")
def k03(s):
    with assembled(s) as data:
        train, val, test = parts(data)
        model, alpha = md.fit_ridge(train, val, "y")
        return report(error(model.transform(test), "ridge").withColumn("alpha", F.lit(alpha)))


@query("k04_boosted_trees")
def k04(s):
    with assembled(s) as data:
        train, val, test = parts(data)
        model, settings = md.fit_gbt(train, val, "y")
        return report(error(model.transform(test), "boosted trees").withColumn("depth", F.lit(settings["maxDepth"])))


def fold_errors(data, year="start_year"):
    """Error of the boosted trees in every year with earlier rows; ``model`` is the year."""
    found = [error(scored, str(at)).withColumns({"depth": F.lit(x["maxDepth"]), "trees": F.lit(x["trees"])}) for at, scored, x in md.nested_folds(data, year, "y")]
    return report(union_all(found)) if found else data.sparkSession.createDataFrame([], "model string, rmse double, mae double, r2 double, depth int, trees int")


@query("k04_expanding_folds")
def k04_folds(s):
    with assembled(s) as data:
        return fold_errors(data)


def indexed(s):
    return ft.with_indexes(inter(s)).groupBy("user_id", "item_id", "user_idx", "item_idx").agg(
        F.max("rating").alias("rating"), F.max("year").alias("year")
    )


@query("k05_factorisation")
def k05(s):
    rows = indexed(s).withColumn("split", ft.temporal_split("year"))
    with cached(rows) as (data,):
        train, _, test = parts(data)
        # Titles are new by construction of the split, so known pairs are scored from the train years.
        model = md.fit_als(train)
        scored = union_all([
            md.als_scores(model, df, train).select("rating", "als_score", F.lit(name).alias("split")) for name, df in (("train", train), ("test", test))
        ])
        return report(ev.reg_metrics(scored, "rating", "als_score", ["split"]))


@query("k06_nearest_item", """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (FROM v WHERE label < 3), t AS (FROM v WHERE label >= 3),
p AS (SELECT q.vec_id, t.vec_id AS item, t.label AS value, round(list_cosine_similarity(q.e, t.e), 12) AS c FROM q, t)
SELECT vec_id, item, value, round(c, 6) AS best FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, item) = 1""")
def k06(s):
    """Vectors of three labels look for their nearest neighbour among all others."""
    rows = s.embeddings
    queries = rows.filter("label < 3").select("vec_id", "embedding")
    items = rows.filter("label >= 3").select(F.col("vec_id").alias("item"), "embedding", F.col("label").alias("value"))
    return md.nearest_item(queries, items, "vec_id", "item", "embedding", "value").withColumn("best", F.round("best", 6))


@query("k07_hybrid")
def k07(s):
    rows = indexed(s).withColumn("split", ft.temporal_split("year"))
    with cached(rows) as (data,):
        train, val, test = parts(data)
        model = md.fit_als(train)
        scores = [md.hybrid_scores(df, md.als_scores(model, df, train), train, item_embeddings(s)) for df in (val, test)]
        hybrid = md.fit_hybrid(scores[0])
        scored = md.predict_hybrid(hybrid, scores[1])
        return report(ev.precision_recall_at_k(scored, "user_id", "score", "rating", "item_id"))


@query("k09_binary_top")
def k09(s):
    return label_report(s, balanced=True, labels=BINARY_LABELS)


@query("k10_stacking")
def k10(s):
    with assembled(s) as data:
        train, val, test = parts(data)
        ridge = linear(train).setPredictionCol("ridge")
        trees, _ = md.fit_gbt(train, val, "y", grid=[{"maxDepth": 3}])
        trees = trees.setPredictionCol("trees")
        base = [md.with_baseline(trees.transform(ridge.transform(df)), train, "y", "mean") for df in (val, test)]
        stacked = md.stack_models(*base, ["mean", "ridge", "trees"], "y")
        return report(union_all([error(stacked, p, p=p) for p in ("mean", "ridge", "trees", "stacked")]))


@query("k10_stacking_labels")
def k10_labels(s):
    """Stacking of label probabilities for the five binary labels: priors by adult flag and a logistic model."""
    with assembled(s, LABEL_FEATURES) as data:
        train, val, test = parts(data)
        models = md.fit_ovr(train, "genres", BINARY_LABELS)
        stacked = []
        for label in BINARY_LABELS:
            share = F.avg(F.array_contains("genres", label).cast("double")).alias("prior")
            prior = train.groupBy("is_adult").agg(share)
            base = [
                md.score_labels(df, {label: models[label]}, "tconst", "genres").withColumnRenamed("prob", "logistic")
                .join(df.select("tconst", "is_adult"), "tconst").join(prior, "is_adult") for df in (val, test)
            ]
            scored = md.stack_models(*base, ["prior", "logistic"], "y", kind="logistic")
            stacked.append(scored.select("tconst", "label", "y", F.col("stacked").alias("prob")))
        return report(ev.multilabel_metrics(union_all(stacked), test, key="tconst", threshold=0.1))


@query("k11_ablation")
def k11(s):
    with cached(frame(s)) as (data,):
        train, _, test = parts(data)
        return report(md.ablation(train, test, FEATURES, GROUPS, linear, "y"))


@query("k12_learning_curve")
def k12(s):
    with assembled(s) as data:
        train, _, test = parts(data)
        return report(md.learning_curve(train, test, linear, "y", "tconst"))


def stored(model, data):
    """The model as it comes back from the shared folder."""
    return load(save(data, model))


@query("k13_score")
def k13(s):
    """All titles scored from raw columns by a stored pipeline."""
    data = frame(s)
    with cached(data) as (rows,):
        prepared = fit_on(rows)
        with cached(prepare(prepared, rows.filter("split = 'train'"))) as (train,):
            model = linear(train)
    return md.score(data, stored(chain(prepared, model), data)).select("tconst", "split", "y", "prediction")


# Modelled titles with a rating, numbers filled and standardised by the train rows, as z1 (year) and z2 (runtime).
STANDARD_SQL = """m AS (SELECT tconst, start_year, runtime_minutes, average_rating AS y FROM dim_title
  WHERE title_type IN ('movie', 'tvSeries', 'tvMiniSeries', 'tvMovie', 'short') AND start_year IS NOT NULL AND average_rating IS NOT NULL),
md AS (SELECT median(runtime_minutes) AS md FROM m WHERE start_year <= 2014),
fl AS (SELECT tconst, start_year, y, start_year AS x1, coalesce(runtime_minutes, md) AS x2 FROM m, md),
st AS (SELECT avg(x1) AS m1, stddev_pop(x1) AS d1, avg(x2) AS m2, stddev_pop(x2) AS d2 FROM fl WHERE start_year <= 2014),
z AS (SELECT tconst, start_year, y, (x1 - m1) / d1 AS z1, (x2 - m2) / d2 AS z2 FROM fl, st)"""
TWO = Columns(numeric=["start_year", "runtime_minutes"])


def two_numbers(s):
    data = s.dim_title.filter(F.col("title_type").isin(ft.FEATURE_TYPES) & F.col("start_year").isNotNull() & F.col("average_rating").isNotNull())
    data = data.select("tconst", "start_year", "runtime_minutes", F.col("average_rating").alias("y"), ft.temporal_split("start_year").alias("split"))
    return data, fit_preprocessor(data.filter("split = 'train'"), TWO)


@query("k03_ridge_closed_form", f"""
WITH {STANDARD_SQL},
s AS (SELECT sum(z1 * z1) AS a, sum(z1 * z2) AS b, sum(z2 * z2) AS c, sum(z1 * y) AS p, sum(z2 * y) AS q, avg(y) AS w0 FROM z WHERE start_year <= 2014),
w AS (SELECT alpha, w0, ((c + alpha) * p - b * q) / ((a + alpha) * (c + alpha) - b * b) AS w1, ((a + alpha) * q - b * p) / ((a + alpha) * (c + alpha) - b * b) AS w2
      FROM s, (SELECT unnest([0.01, 0.1, 1.0, 10.0, 1000.0]) AS alpha))
SELECT CAST(alpha AS DOUBLE) AS alpha, round(w0, 6) AS intercept, round(w1, 6) AS year_weight, round(w2, 6) AS runtime_weight,
       (SELECT round(sqrt(avg((y - w0 - w1 * z1 - w2 * z2) ** 2)), 6) FROM z WHERE start_year BETWEEN 2015 AND 2018) AS rmse FROM w""")
def k03_closed_form(s):
    """Two standardised numbers, every penalty of the grid."""
    data, prepared = two_numbers(s)
    with cached(prepare(prepared, data)) as (rows,):
        train, val, _ = parts(rows)
        alphas, found = (0.01, 0.1, 1.0, 10.0, 1000.0), []
        for alpha, model in zip(alphas, md.ridge(train, alphas, "y")):
            weights = [F.round(F.lit(float(x)), 6) for x in (model.intercept, *model.coefficients)]
            rmse = F.round("rmse", 6).alias("rmse")
            found.append(ev.reg_metrics(model.transform(val), "y", "prediction").select(
                F.lit(alpha).alias("alpha"), *[w.alias(c) for w, c in zip(weights, ("intercept", "year_weight", "runtime_weight"))], rmse))
        return report(union_all(found))


@query("k13_score_given", f"""
WITH {STANDARD_SQL} SELECT tconst, round(least(greatest(6.0 + 3.0 * z1 - 2.5 * z2, 1.0), 10.0), 6) AS prediction FROM z""")
def k13_given(s):
    """A stored pipeline with given weights; many predictions leave the rating scale."""
    data, prepared = two_numbers(s)
    given = SQLTransformer(statement="SELECT *, 6.0D + 3.0D * start_year_scaled - 2.5D * runtime_minutes_scaled AS prediction FROM __THIS__")
    return md.score(data, stored(chain(prepared, given), data)).select("tconst", F.round("prediction", 6).alias("prediction"))


@query("l13_noise_curve")
def l13(s):
    """Error of a linear model as its inputs get noisier, against the clean error."""
    with cached(frame(s)) as (rows,):
        prepared = fit_on(rows)
        train, _, test = parts(rows)
        model = linear(prepare(prepared, train))
        clean = error(model.transform(prepare(prepared, test)), "clean")
        found = [clean.withColumn("level", F.lit(0.0))]
        for level in (0.05, 0.1, 0.2):
            noisy = ft.add_noise(test, NUMERIC, level, seed=42)
            found.append(error(model.transform(prepare(prepared, noisy)), "noisy").withColumn("level", F.lit(level)))
        whole = report(union_all(found))
    base = whole.filter("level = 0").agg(F.max("rmse")).scalar()
    return whole.withColumn("increase_pct", 100 * (F.col("rmse") / base - 1))
