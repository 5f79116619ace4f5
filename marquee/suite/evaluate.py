"""Evaluation of simple models fitted on the bound tables."""

from pyspark.sql import functions as F

from marquee.functions.scalars import split_list
from marquee.operators import evaluate as ev
from marquee.operators import features as ft
from marquee.operators.paging import union_all
from marquee.suite.core import query
from marquee.suite.features import INTER_SQL, inter


# Genre priors by title type, learned on train years, score every later title: (key, label, y, prob) in sparse form.
PRIOR_SQL = """
t AS (SELECT tconst, title_type, string_split(genre_list, ', ') AS gs, start_year FROM dim_title WHERE start_year IS NOT NULL),
tr AS (SELECT title_type, count(*) AS n FROM t WHERE start_year <= 2014 GROUP BY ALL),
pr AS (SELECT title_type, g AS label, count(*) / any_value(n) AS prob FROM
  (SELECT title_type, unnest(gs) AS g FROM t WHERE start_year <= 2014) JOIN tr USING (title_type) GROUP BY ALL),
te AS (SELECT * FROM t WHERE start_year > 2014),
pairs AS (SELECT te.tconst, pr.label, CASE WHEN list_contains(te.gs, pr.label) THEN 1 ELSE 0 END AS y, pr.prob FROM te JOIN pr USING (title_type))"""


def priors(s):
    """(test titles, scored pairs): every genre seen for a title's type, with its share there."""
    titles = s.dim_title.filter("start_year IS NOT NULL").select("tconst", "title_type", "start_year", split_list("genre_list").alias("gs"))
    train, test = titles.filter("start_year <= 2014"), titles.filter("start_year > 2014")
    sizes = train.groupBy("title_type").agg(F.count("*").alias("n"))
    counts = train.select("title_type", F.explode("gs").alias("label")).groupBy("title_type", "label").agg(F.count("*").alias("c"))
    prior = counts.join(sizes, "title_type").select("title_type", "label", (F.col("c") / F.col("n")).alias("prob"))
    y = F.coalesce(F.array_contains("gs", F.col("label")), F.lit(False)).cast("int").alias("y")
    return test, test.join(prior, "title_type").select("tconst", "label", y, "prob")


@query("l01_multilabel_metrics", f"""
WITH {PRIOR_SQL},
m AS (SELECT label, sum(CASE WHEN y = 1 AND prob > 0.12 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y = 0 AND prob > 0.12 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y = 1 AND prob <= 0.12 THEN 1 ELSE 0 END) AS fn FROM pairs GROUP BY label),
exact AS (SELECT tconst, bool_and((y = 1) = (prob > 0.12)) AS ok FROM pairs GROUP BY tconst)
SELECT round(avg(CASE WHEN tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END), 8) AS macro_f1,
  round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 8) AS micro_f1,
  round(avg(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END), 8) AS macro_precision,
  round(avg(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END), 8) AS macro_recall,
  round(sum(fp + fn) / (count(*) * (SELECT count(*) FROM te)), 8) AS hamming_loss,
  round((SELECT count(*) FILTER (WHERE ok) / count(*) FROM exact), 8) AS subset_accuracy FROM m""")
def l01(s):
    test, pairs = priors(s)
    found = ev.multilabel_metrics(pairs, test, key="tconst", threshold=0.12)
    return found.select(*[F.round(c, 8).alias(c) for c in found.columns])


# Rating by the mean of the title's type in the train years.
RATED_SQL = """
r AS (SELECT tconst, title_type, start_year, average_rating AS y FROM dim_title WHERE average_rating IS NOT NULL AND start_year IS NOT NULL),
tm AS (SELECT title_type, avg(y) AS p FROM r WHERE start_year <= 2014 GROUP BY title_type),
scored AS (SELECT r.*, tm.p, CASE WHEN start_year <= 2014 THEN 'train' WHEN start_year <= 2018 THEN 'val' ELSE 'test' END AS split FROM r JOIN tm USING (title_type))"""


def rated(s):
    titles = s.dim_title.filter("average_rating IS NOT NULL AND start_year IS NOT NULL")
    return titles.select("tconst", "title_type", "start_year", F.col("average_rating").alias("y"), ft.temporal_split("start_year").alias("split"))


def scored_ratings(s):
    rows = rated(s)
    means = rows.filter("split = 'train'").groupBy("title_type").agg(F.avg("y").alias("p"))
    return rows.join(means, "title_type")


METRIC_SQL = """round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
  round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2"""


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("l02_reg_metrics", f"WITH {RATED_SQL} SELECT split, {METRIC_SQL} FROM scored GROUP BY split")
def l02(s):
    return rounded(ev.reg_metrics(scored_ratings(s), "y", "p", ["split"]), "rmse", "mae", "r2")


@query("l03_q_error", f"""
WITH {RATED_SQL}, q AS (SELECT greatest(p / y, y / p) AS e FROM scored WHERE split = 'test')
SELECT round(quantile_cont(e, 0.5), 6) AS q_error_p50, round(quantile_cont(e, 0.9), 6) AS q_error_p90,
  round(quantile_cont(e, 0.95), 6) AS q_error_p95, round(quantile_cont(e, 0.99), 6) AS q_error_p99 FROM q""")
def l03(s):
    found = ev.q_error(scored_ratings(s).filter("split = 'test'"), "y", "p")
    return rounded(found, *found.columns)


# Items scored by their mean rating over the years before; ties by item.
ITEM_SQL = """
w AS (SELECT user_id, item_id, max(rating) AS rating, max(year) AS year FROM inter GROUP BY ALL),
sc AS (SELECT w.*, d.num_votes AS score FROM w JOIN dim_title d ON d.tconst = w.item_id)"""


def scored_items(s):
    """One row per user and item, scored by popularity."""
    rows = inter(s).groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"), F.max("year").alias("year"))
    votes = s.dim_title.select(F.col("tconst").alias("item_id"), F.col("num_votes").alias("score"))
    return rows.join(votes, "item_id")


@query("l04_precision_recall_at_k", f"""
WITH {INTER_SQL}, {ITEM_SQL},
k AS (SELECT user_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS i FROM sc),
u AS (SELECT user_id, count(*) FILTER (WHERE i <= 10 AND rating >= 7) AS hits, count(*) FILTER (WHERE rating >= 7) AS rel FROM k GROUP BY user_id)
SELECT round(avg(hits / 10), 8) AS precision_at_k, round(avg(CASE WHEN rel > 0 THEN hits / rel ELSE 0 END), 8) AS recall_at_k FROM u""")
def l04(s):
    found = ev.precision_recall_at_k(scored_items(s), "user_id", "score", "rating", "item_id")
    return rounded(found, "precision_at_k", "recall_at_k", digits=8)


# Cold users here: fewer than 120 train rows, since the bound people are all busy.
@query("l05_cold_start", f"""
WITH {INTER_SQL}, c AS (SELECT user_id FROM inter WHERE year <= 2014 GROUP BY user_id HAVING count(*) < 120)
SELECT * FROM inter WHERE year > 2014 AND user_id IN (FROM c)""")
def l05(s):
    rows = inter(s)
    return ev.cold_start(rows.filter("year <= 2014"), rows.filter("year > 2014"), "user_id", 120)


GATES = {
    "rating_error": ("test_rmse", "<=", 3.0), "rating_error_strict": ("test_rmse", "<", 0.55), "generalisation": ("val_test_delta", "<", 0.1),
    "explained": ("test_r2", ">", 0.6), "rows": ("test_rows", ">=", 10.0), "naming": ("naming_compliant", "==", 1.0),
}
SPLIT_METRICS_SQL = f"""
mt AS (SELECT split, sqrt(avg((p - y) * (p - y))) AS rmse, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) AS r2, count(*) AS n FROM scored GROUP BY split),
ml AS (SELECT 'test_rmse' AS metric, rmse AS value FROM mt WHERE split = 'test' UNION ALL SELECT 'test_r2', r2 FROM mt WHERE split = 'test'
  UNION ALL SELECT 'test_rows', n FROM mt WHERE split = 'test'
  UNION ALL SELECT 'val_test_delta', abs((SELECT rmse FROM mt WHERE split = 'val') - (SELECT rmse FROM mt WHERE split = 'test')))"""


def split_metrics(s):
    """(metric, value) of the type-mean model."""
    scored = scored_ratings(s)
    by_split = ev.reg_metrics(scored, "y", "p", ["split"])
    sizes = scored.groupBy("split").agg(F.count("*").alias("n"))
    of = lambda name, c: F.max(F.when(F.col("split") == name, F.col(c)))
    wide = by_split.join(sizes, "split").agg(
        of("test", "rmse").alias("test_rmse"), of("test", "r2").alias("test_r2"), of("test", "n").alias("test_rows"),
        F.abs(of("val", "rmse") - of("test", "rmse")).alias("val_test_delta"),
    )
    return ev.stack_metrics(wide, "type_mean")


@query("l06_quality_gates", f"""
WITH {RATED_SQL}, {SPLIT_METRICS_SQL},
g AS (SELECT * FROM (VALUES {', '.join(f"('{g}', '{m}', '{op}', CAST({t} AS DOUBLE))" for g, (m, op, t) in GATES.items())}) v(gate, metric, op, threshold))
SELECT gate, metric, op, threshold, round(value, 6) AS value, coalesce(CASE op WHEN '<' THEN value < threshold WHEN '<=' THEN value <= threshold
  WHEN '>' THEN value > threshold WHEN '>=' THEN value >= threshold WHEN '==' THEN value = threshold END, false) AS passed FROM g LEFT JOIN ml USING (metric)""")
def l06(s):
    return rounded(ev.evaluate_gates(split_metrics(s), GATES), "value")


AUDITED = ["num_votes", "runtime_minutes", "start_year", "aka_count"]


@query("l07_feature_audit", "WITH i AS ("
       + " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, average_rating)) AS v FROM dim_title" for c in AUDITED)
       + ") SELECT feature, round(v / sum(v) OVER (), 6) AS importance, v / sum(v) OVER () <= 0.8 AS passed FROM i")
def l07(s):
    """Importance of a feature: its absolute correlation with the rating."""
    wide = s.dim_title.agg(*[F.abs(F.corr(c, "average_rating")).alias(c) for c in AUDITED])
    importances = ev.stack_metrics(wide, "corr").select(F.col("metric").alias("feature"), F.col("value").alias("importance"))
    return rounded(ev.feature_audit(importances), "importance")


# Three rating models: global mean, mean by type, mean by type and decade.
MODELS_SQL = """
r AS (SELECT title_type, start_year - start_year % 10 AS dec, start_year, average_rating AS y,
  CASE WHEN start_year <= 2014 THEN 'train' WHEN start_year <= 2018 THEN 'val' ELSE 'test' END AS split
  FROM dim_title WHERE average_rating IS NOT NULL AND start_year IS NOT NULL),
g AS (SELECT avg(y) AS p FROM r WHERE split = 'train'), a AS (SELECT title_type, avg(y) AS p FROM r WHERE split = 'train' GROUP BY ALL),
b AS (SELECT title_type, dec, avg(y) AS p FROM r WHERE split = 'train' GROUP BY ALL),
err AS (SELECT 'global_mean' AS name, split, y, g.p FROM r, g UNION ALL SELECT 'type_mean', split, y, a.p FROM r JOIN a USING (title_type)
  UNION ALL SELECT 'type_decade_mean', split, y, coalesce(b.p, g.p) FROM r LEFT JOIN b USING (title_type, dec), g),
me AS (SELECT name, split, sqrt(avg((p - y) * (p - y))) AS rmse, avg(abs(p - y)) AS mae, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) AS r2 FROM err GROUP BY ALL)"""


def model_metrics(s):
    """(name, split, rmse, mae, r2) of three mean models."""
    rows = rated(s).withColumn("dec", (F.col("start_year") - F.col("start_year") % 10))
    train = rows.filter("split = 'train'")
    overall = train.agg(F.avg("y")).scalar()
    by_type = train.groupBy("title_type").agg(F.avg("y").alias("p"))
    by_decade = train.groupBy("title_type", "dec").agg(F.avg("y").alias("p"))
    models = {
        "global_mean": rows.withColumn("p", overall), "type_mean": rows.join(by_type, "title_type"),
        "type_decade_mean": rows.join(by_decade, ["title_type", "dec"], "left").withColumn("_g", overall).withColumn("p", F.coalesce("p", "_g")),
    }
    return union_all([ev.reg_metrics(df, "y", "p", ["split"]).select(F.lit(name).alias("name"), "split", "rmse", "mae", "r2") for name, df in models.items()])


@query("l08_temporal_decay", f"""
WITH {MODELS_SQL} SELECT v.name, round(v.rmse, 6) AS val, round(t.rmse, 6) AS test, round(t.rmse - v.rmse, 6) AS delta
FROM me v JOIN me t ON t.name = v.name AND v.split = 'val' AND t.split = 'test'""")
def l08(s):
    metrics = model_metrics(s).select("name", F.concat("split", F.lit("_rmse")).alias("metric"), F.col("rmse").alias("value"))
    return rounded(ev.temporal_decay(metrics), "val", "test", "delta")


@query("l09_label_distribution", """
SELECT label, count(*) AS n FROM (SELECT unnest(string_split(genre_list, ', ')) AS label FROM dim_title WHERE start_year <= 2014) GROUP BY label""")
def l09(s):
    return ev.label_distribution(s.dim_title.filter("start_year <= 2014"), "genre_list")


@query("l10_split_year_ranges", """
SELECT CASE WHEN start_year <= 2014 THEN 'train' WHEN start_year <= 2018 THEN 'val' ELSE 'test' END AS split, min(start_year) AS min_year,
  max(start_year) AS max_year, median(start_year) AS median_year, count(*) AS n FROM dim_title WHERE start_year IS NOT NULL GROUP BY 1""")
def l10(s):
    titles = s.dim_title.filter("start_year IS NOT NULL").withColumn("split", ft.temporal_split("start_year"))
    return ev.split_year_ranges(titles)


PILLARS = {"rmse": False, "r2": True, "mae": False}


@query("l11_rank_models", f"""
WITH {MODELS_SQL}, x AS (SELECT * FROM me WHERE split = 'test' AND name <> 'global_mean' OR split = 'val' AND name = 'global_mean'),
z AS (SELECT name, 1 - (rmse - min(rmse) OVER ()) / (max(rmse) OVER () - min(rmse) OVER ()) AS a, (r2 - min(r2) OVER ()) / (max(r2) OVER () - min(r2) OVER ()) AS b FROM x),
c AS (SELECT name, 1 - (mae - min(mae) OVER ()) / (max(mae) OVER () - min(mae) OVER ()) AS c FROM x WHERE name <> 'global_mean')
SELECT name, round(a, 6) AS rmse, round(b, 6) AS r2, round(coalesce(c, 0), 6) AS mae, round((a + b + coalesce(c, 0)) / 3, 6) AS overall FROM z LEFT JOIN c USING (name)""")
def l11(s):
    """Pillars are the three metrics here; the global mean lacks one of them."""
    rows = model_metrics(s).filter("split = 'test' AND name <> 'global_mean' OR split = 'val' AND name = 'global_mean'")
    entries = F.explode(F.array(*[F.struct(F.lit(m).alias("pillar"), F.col(m).alias("value")) for m in PILLARS])).alias("_e")
    long = rows.select("name", entries).select("name", "_e.*").filter("NOT (name = 'global_mean' AND pillar = 'mae')")
    ranked = ev.rank_models(long, PILLARS)
    return rounded(ranked, *PILLARS, "overall")


@query("l12_promote", f"""
WITH {MODELS_SQL}, pr AS (SELECT * FROM me WHERE name = 'global_mean')
SELECT n.split AS model, round(n.rmse, 6) AS new_value, round(pr.rmse * CASE n.split WHEN 'val' THEN 0.5 ELSE 1 END, 6) AS prod_value,
  NOT n.rmse > 1.05 * pr.rmse * CASE n.split WHEN 'val' THEN 0.5 ELSE 1 END AS promote FROM me n JOIN pr USING (split) WHERE n.name = 'type_mean'""")
def l12(s):
    """The type means against the global mean on each split; on one split production is made twice as good."""
    rows = model_metrics(s)
    side = lambda name: rows.filter(F.col("name") == name).select(
        F.col("split").alias("model"), F.col("rmse").alias("value"), F.lit(False).alias("higher_is_better"))
    halved = F.when(F.col("model") == "val", F.col("value") * 0.5).otherwise(F.col("value"))
    return rounded(ev.promote_ok(side("type_mean"), side("global_mean").withColumn("value", halved)), "new_value", "prod_value")


@query("k08_tune_thresholds", f"""
WITH {PRIOR_SQL}, th AS (SELECT x / 20.0 AS t FROM range(2, 19) v(x)),
sc AS (SELECT label, t, count(*) FILTER (WHERE y = 1 AND s >= t) AS tp, count(*) FILTER (WHERE y = 0 AND s >= t) AS fp, count(*) FILTER (WHERE y = 1 AND s < t) AS fn
  FROM (SELECT label, y, least(prob * 3 + y * 0.1, 1) AS s FROM pairs), th GROUP BY ALL),
f AS (SELECT label, t, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM sc)
SELECT label, CAST(CASE WHEN f1 > 0 THEN t ELSE 0.5 END AS DOUBLE) AS threshold, round(f1, 8) AS f1 FROM f
QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) = 1""")
def k08(s):
    """Priors sharpened by the answer, so that thresholds matter."""
    _, pairs = priors(s)
    sharp = pairs.withColumn("prob", F.least(F.col("prob") * 3 + F.col("y") * 0.1, F.lit(1)))
    return rounded(ev.tune_thresholds(sharp), "f1", digits=8)
