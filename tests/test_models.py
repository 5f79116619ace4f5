"""Splits, metrics, gates, models and graph measures on small inputs worked out by hand or by brute force."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from marquee.operators import evaluate as ev
from marquee.operators import features as ft
from marquee.operators import models as md
from marquee.operators import prepare
from marquee.operators import quality as dq
from marquee.plans import analytics as an
from marquee.suite import models


def test_split_boundaries(spark):
    df = spark.createDataFrame([(2014,), (2015,), (2018,), (2019,), (None,)], "y int")
    assert [r[0] for r in df.select(ft.temporal_split("y")).collect()] == ["train", "val", "val", "test", None]


def test_leakage_guard():
    assert ft.assert_no_leakage(["start_year"]) == ["start_year"]
    with pytest.raises(ValueError, match="average_rating"):
        ft.assert_no_leakage(["start_year", "average_rating"])


def test_minmax_zero_range(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 5.0)], "a double, b double")
    got = [tuple(r) for r in ft.safe_minmax(df, ["a", "b"]).select("a_scaled", "b_scaled").collect()]
    assert got == [(0.0, 0.0), (0.0, 1.0)]


def test_crew_features_equal_the_expanded_join(spark):
    """The weighted sums equal averages over the rows that a join to the yearly statistics creates."""
    titles = spark.createDataFrame([(t, "movie", 2000 + t % 4) for t in range(12)], "tconst int, title_type string, start_year int")
    perf = spark.createDataFrame([(t, p, "director") for t in range(12) for p in (1, 2) if (t + p) % 3], "tconst int, nconst int, category string")
    stats = ft.person_year_stats(perf, titles)
    wide = perf.join(titles, "tconst").join(stats, ["nconst", "category", "start_year"]).groupBy("tconst").agg(
        F.avg("cumulative_credits").alias("e"), F.avg("recent_5yr_credits").alias("r"), F.avg("career_length").alias("c"))
    both = ft.crew_features(perf, titles).join(wide, "tconst").collect()
    assert len(both) == 12
    for r in both:
        assert (r["dir_avg_experience"], r["dir_avg_recent_activity"], r["dir_avg_career_len"]) == pytest.approx((r["e"], r["r"], r["c"]))


def test_precision_recall(spark):
    rows = [(0, 0, 8.0, 0.9), (0, 1, 5.0, 0.3), (0, 2, 9.0, 0.8), (1, 3, 6.0, 0.4), (1, 4, 7.0, 0.7), (1, 5, 8.0, 0.6)]
    df = spark.createDataFrame(rows, "u int, i int, rating double, score double")
    assert tuple(ev.precision_recall_at_k(df, "u", "score", "rating", "i", k=2, threshold=7).first()) == (1.0, 1.0)
    one = ev.precision_recall_at_k(df, "u", "score", "rating", "i", k=1, threshold=7).first()
    assert tuple(one) == (1.0, 0.5)
    assert tuple(ev.precision_recall_at_k(df, "u", "score", "rating", "i", k=4, threshold=7).first()) == (0.5, 1.0)


def test_multilabel(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "key int")
    pairs = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 0, 0.6), (2, "a", 1, 0.5), (3, "b", 1, 0.7)], "key int, label string, y int, prob double")
    m = ev.multilabel_metrics(pairs, keys).first().asDict()
    # a: tp 1, fn 1 (0.5 is not above the threshold); b: tp 1, fp 1
    assert m["macro_f1"] == pytest.approx(2 / 3) and m["micro_f1"] == pytest.approx(2 / 3)
    assert m["hamming_loss"] == pytest.approx(2 / 6) and m["subset_accuracy"] == pytest.approx(1 / 3)


def test_regression_and_q_error(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 2.0), (0.0, 3.0), (3.0, None)], "y double, p double")
    m = ev.reg_metrics(df, "y", "p").first()
    assert m["rmse"] == pytest.approx(np.sqrt((1 + 0 + 4 + 9) / 4)) and m["mae"] == pytest.approx(1.5)
    q = ev.q_error(df, "y", "p").first()
    assert q["q_error_p50"] == 2.0 and q["q_error_p99"] == pytest.approx(2.0)


def test_gates(spark):
    metrics = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "metric string, value double")
    gates = {"le": ("a", "<=", 0.5), "lt": ("a", "<", 0.5), "eq": ("b", "==", 1.0), "missing": ("c", ">", 0.0)}
    got = {r["gate"]: r["passed"] for r in ev.evaluate_gates(metrics, gates).collect()}
    assert got == {"le": True, "lt": False, "eq": True, "missing": False}


def test_feature_audit(spark):
    df = spark.createDataFrame([("x", 9.0), ("y", 1.0)], "feature string, importance double")
    assert {r["feature"]: r["passed"] for r in ev.feature_audit(df).collect()} == {"x": False, "y": True}


def test_promotion(spark):
    shape = "model string, value double, higher_is_better boolean"
    new = spark.createDataFrame([("f1", 0.94, True), ("f1b", 0.96, True), ("rmse", 1.06, False), ("fresh", 9.0, False)], shape)
    old = spark.createDataFrame([("f1", 1.0, True), ("f1b", 1.0, True), ("rmse", 1.0, False)], shape)
    assert {r["model"]: r["promote"] for r in ev.promote_ok(new, old).collect()} == {"f1": False, "f1b": True, "rmse": False, "fresh": True}


def test_thresholds_match_search(spark):
    rng = np.random.default_rng(5)
    rows = [(label, int(rng.random() < 0.3), float(rng.random())) for label in "ab" for _ in range(200)] + [("none", 0, 0.05)]
    got = {r["label"]: (r["threshold"], r["f1"]) for r in ev.tune_thresholds(spark.createDataFrame(rows, "label string, y int, prob double")).collect()}
    for label in "ab":
        y = np.array([r[1] for r in rows if r[0] == label])
        p = np.array([r[2] for r in rows if r[0] == label])
        best, at = 0, 0.5
        for t in [x / 20 for x in range(2, 19)]:
            hit = p >= t
            f1 = 2 * (hit & (y == 1)).sum() / (2 * (hit & (y == 1)).sum() + (hit & (y == 0)).sum() + (~hit & (y == 1)).sum())
            if f1 > best:
                best, at = f1, t
        assert got[label] == pytest.approx((at, best))
    assert got["none"] == (0.5, 0.0)


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_item_is_exact(spark, monkeypatch, clustered):
    """Several pivots, chunks and blocks, copies among the items, and most items in one spot."""
    monkeypatch.setattr(md, "PIVOTS", 6)
    monkeypatch.setattr(md, "CHUNK_ROWS", 20)
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(150, 8))
    if clustered:
        vectors = rng.normal(size=(5, 8))[rng.choice(5, 150, p=[0.6, 0.1, 0.1, 0.1, 0.1])] + 0.05 * vectors
    vectors[10] = vectors[11]
    items = spark.createDataFrame([(i, [float(x) for x in vectors[i]], i * 10) for i in range(100)], "item int, e array<double>, value int")
    queries = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in range(100, 150)] + [(999, [float(x) for x in vectors[11]])], "q int, e array<double>")
    got = {r["q"]: (r["item"], r["value"]) for r in md.nearest_item(queries, items, "q", "item", "e", "value").collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for i in range(100, 150):
        best = int(np.round(unit[:100] @ unit[i], 12).argmax())
        assert got[i] == (best, best * 10)
    assert got[999] == (10, 100) and len(got) == 51


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_item_in_two_levels_is_exact(spark, monkeypatch, clustered):
    monkeypatch.setattr(md, "PIVOTS", 3)
    monkeypatch.setattr(md, "CHUNK_ROWS", 8)
    monkeypatch.setattr(md, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(230, 6))
    if clustered:
        vectors = rng.normal(size=(12, 6))[rng.choice(12, 230)] + 0.02 * vectors
    vectors[5] = vectors[6]
    items = spark.createDataFrame([(i, [float(x) for x in vectors[i]], i * 10) for i in range(200)], "item int, e array<double>, value int")
    queries = spark.createDataFrame([(i, [float(x) for x in vectors[i]]) for i in [6, *range(200, 230)]], "q int, e array<double>")
    got = {r["q"]: (r["item"], r["value"]) for r in md.nearest_item(queries, items, "q", "item", "e", "value").collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {i: int(np.round(unit[:200] @ unit[i], 12).argmax()) for i in [6, *range(200, 230)]}
    assert got == {i: (best, best * 10) for i, best in want.items()} and want[6] == 5


def test_pivots_grow_with_the_items(spark):
    assert [md.pivot_count(n) for n in (0, 1, 100, 10**6, 10**9, 10**12)] == [1, 1, 64, 64, 494, 15625]
    items = spark.createDataFrame([], "item int, e array<double>, value int")
    queries = spark.createDataFrame([(1, [1.0])], "q int, e array<double>")
    assert md.nearest_item(queries, items, "q", "item", "e", "value").count() == 0


def test_user_profile_falls_back_to_mean(spark):
    inter = spark.createDataFrame([(1, 1, 8.0), (1, 2, 9.0), (2, 1, 3.0)], "user_id int, item_id int, rating double")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], "item_id int, embedding array<double>")
    got = {r["user_id"]: r["profile"] for r in ft.user_profiles(inter, emb).collect()}
    assert got == {1: [0.5, 0.5], 2: [2.0, 2.0]}


def test_drift_shift_needs_baseline_edges(spark):
    from marquee.operators import aggregates as ag

    old = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    new = old.select((F.col("v") + 50).alias("v"))
    base = ag.histograms(old, ["v"])
    own = ft.drift(base, ag.histograms(new, ["v"])).first()
    shared = ft.drift(base, ag.histograms(new, ["v"], edges=ag.column_edges(old, ["v"]))).first()
    assert not own["drifted"] and shared["drifted"]


def test_communities_and_degree(spark):
    edges = spark.createDataFrame([(1, 2, 3), (2, 3, 3), (1, 3, 3), (4, 5, 2), (5, 6, 2), (4, 6, 2), (3, 4, 1)], "a int, b int, weight int")
    labels = {r["node"]: r["label"] for r in an.communities(edges, 10).collect()}
    assert len({labels[n] for n in (1, 2, 3)}) == 1 and labels[1] != labels[5]
    degree = {r["node"]: r["centrality"] for r in an.degree_centrality(edges).collect()}
    assert degree[3] == pytest.approx(3 / 5) and degree[1] == pytest.approx(2 / 5)


def test_communities_with_an_isolated_pair(spark):
    triangles = [(1, 2, 3), (2, 3, 3), (1, 3, 3), (4, 5, 2), (5, 6, 2), (4, 6, 2), (3, 4, 1)]
    star = [(20, n, 2) for n in (21, 22, 23)]
    edges = spark.createDataFrame([*triangles, (10, 11, 5), *star], "a int, b int, weight int")
    labels = {r["node"]: r["label"] for r in an.communities(edges, 20).collect()}
    found = {frozenset(n for n in labels if labels[n] == label) for label in labels.values()}
    assert found == {frozenset(c) for c in ((1, 2, 3), (4, 5, 6), (10, 11), (20, 21, 22, 23))}


def test_communities_settle_on_alternating_graphs(spark):
    square = [(1, 2, 5), (2, 3, 1), (3, 4, 5), (4, 1, 1), (4, 5, 5), (5, 6, 1), (6, 7, 7), (7, 8, 2), (8, 5, 2)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in square], "a int, b int, weight int")
    labels = {r["node"]: r["label"] for r in an.communities(edges, 40).collect()}
    for node in labels:
        votes = {}
        for a, b, w in square:
            if node in (a, b):
                other = labels[a + b - node]
                votes[other] = votes.get(other, 0) + w
        assert votes.get(labels[node], 0) == max(votes.values())


def test_expanding_folds_cover_every_year_with_earlier_rows(spark):
    rows = [(year, [float(i), float(year % 2)], float(i % 5)) for year in (1999, 2001, 2002, 2010) for i in range(12)]
    df = spark.createDataFrame([*rows, (None, [1.0, 1.0], 1.0)], "start_year int, f array<double>, y double")
    data = df.select("start_year", array_to_vector("f").alias("features"), "y")
    got = models.fold_errors(data).collect()
    assert sorted(r["model"] for r in got) == ["2001", "2002", "2010"] and all(r["rmse"] >= 0 for r in got)
    assert models.fold_errors(data.filter("start_year = 1999")).count() == 0


@pytest.mark.parametrize("rounds", [0, 1])
def test_communities_end_without_a_limit(spark, rounds):
    """Labels that have not settled in the given rounds go on until no node would gain by leaving."""
    square = [(1, 2, 5), (2, 3, 1), (3, 4, 5), (1, 4, 1), (4, 5, 5), (5, 6, 1), (6, 7, 7), (7, 8, 2), (5, 8, 2), (10, 11, 1)]
    labels = {r["node"]: r["label"] for r in an.communities(spark.createDataFrame(square, "a int, b int, weight int"), rounds).collect()}
    assert len(labels) == 10
    for node in labels:
        votes = {}
        for a, b, w in square:
            if node in (a, b):
                votes[labels[a + b - node]] = votes.get(labels[a + b - node], 0) + w
        assert votes.get(labels[node], 0) == max(votes.values())
    assert an.communities(spark.createDataFrame([], "a int, b int, weight int"), rounds).count() == 0


def test_the_scored_year_takes_no_part_in_its_model(spark):
    rng = np.random.default_rng(4)
    rows = [(year, [float(x) for x in rng.normal(size=2)], float(rng.integers(1, 10))) for year in (2000, 2001, 2002, 2003) for _ in range(30)]

    def predictions(change):
        changed = [(y, f, 10 - v if y == change else v) for y, f, v in rows]
        df = spark.createDataFrame(changed, "start_year int, f array<double>, y double").select("start_year", array_to_vector("f").alias("features"), "y")
        folds = md.nested_folds(df, "start_year", "y", rounds=5, threads=2)
        return {year: (sorted(r["prediction"] for r in scored.collect()), settings) for year, scored, settings in folds}

    plain, changed = predictions(None), predictions(2002)
    assert set(plain) == {2001, 2002, 2003}
    assert plain[2001] == changed[2001] and plain[2002] == changed[2002] and plain[2003] != changed[2003]


def test_stored_preprocessor(spark):
    """Median and population deviation, unseen category and list item, nulls, and the same vectors after loading."""
    shape = "k int, x double, c string, l string, t string"
    train = spark.createDataFrame([(1, 1.0, "a", "p, q", "one two"), (2, 3.0, "b", "q", "two"), (3, 8.0, None, None, None), (4, None, "a", "", "one")], shape)
    model = prepare.fit_preprocessor(train, prepare.Columns(["x"], ["c"], ["l"], ["t"], text_size=3))
    new = spark.createDataFrame([(1, float("nan"), "z", "r", "three"), (2, 8.0, None, "q,p,r", "two one two")], shape)
    stored = prepare.load(prepare.save(train, model))
    one, other = ([r["features"].toArray().tolist() for r in prepare.prepare(m, new).orderBy("k").collect()] for m in (model, stored))
    assert one == other
    filled = np.array([1.0, 3.0, 8.0, 3.0])
    assert [v[0] for v in one] == pytest.approx([(3 - filled.mean()) / filled.std(), (8 - filled.mean()) / filled.std()])
    assert one[0][1:] == [0.0] * 8  # no known category, list item or word
    assert one[1][1:4] == [0.0, 0.0, 1.0] and one[1][4:6] == [1.0, 1.0]  # a, b, missing; q, p
    words = {r["word"]: r["vector"].toArray() for r in next(s for s in stored.stages[0].stages if hasattr(s, "getVectors")).getVectors().collect()}
    assert one[1][6:] == pytest.approx(((2 * words["two"] + words["one"]) / 3).tolist())
    assert prepare.prepare(stored, new).columns == [*new.columns, "features"]


def test_numbers_without_spread_or_values(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, None)], "a double, b double")
    stats = {r["feature"]: (r["fill"], r["mean"], r["sd"]) for r in prepare.numeric_statistics(df, ["a", "b"]).collect()}
    assert stats == {"a": (5.0, 5.0, 0.0), "b": (0.0, 0.0, 0.0)}
    vectors = prepare.prepare(prepare.fit_preprocessor(df, prepare.Columns(["a", "b"])), df)
    assert [r["features"].toArray().tolist() for r in vectors.collect()] == [[0.0, 0.0]] * 2


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(80, 3)), rng.normal(size=80) * 3 + 1
    x = x - x.mean(axis=0)
    df = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "f array<double>, y double").select(array_to_vector("f").alias("features"), "y")
    for alpha, model in zip((0.1, 50.0), md.ridge(df, (0.1, 50.0), "y")):
        want = np.linalg.solve(x.T @ x + alpha * np.eye(3), x.T @ (y - y.mean()))
        assert model.coefficients.toArray() == pytest.approx(want, rel=1e-6)


def test_factors_are_checkpointed_in_every_iteration(spark, monkeypatch):
    """Else the shuffle files of all iterations stay on disk."""
    made, real = {}, md.ALS
    monkeypatch.setattr(md, "ALS", lambda **settings: made.update(settings) or real(**settings))
    rows = [(u, i, float((u + i) % 5)) for u in range(6) for i in range(6)]
    model = md.fit_als(spark.createDataFrame(rows, "user_idx long, item_idx long, rating double"), rank=2, iterations=3)
    assert made["checkpointInterval"] == 1 and spark.sparkContext.getCheckpointDir() and model.userFactors.count() == 6


@pytest.mark.parametrize("balanced", [False, True])
def test_labels_fitted_together_equal_models_of_their_own(spark, monkeypatch, balanced):
    """All labels in the same few passes, against Spark's learner label by label; also labels of all rows and of none."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        x = rng.normal(size=3) * [1, 5, 0.2]
        rows.append(([float(v) for v in x] + [2.0], [g for g, hit in (("a", x[0] > 0.3 + rng.normal()), ("b", x[1] > 9), ("all", True)) if hit] or None))
    df = spark.createDataFrame(rows, "f array<double>, genres array<string>").select(array_to_vector("f").alias("features"), "genres").coalesce(3)
    labels, passes, real = ["a", "b", "all", "no"], [], md._summed
    monkeypatch.setattr(md, "_summed", lambda *a: passes.append(1) or real(*a))
    got = md.fit_ovr(df, "genres", labels, balanced)
    assert 3 <= len(passes) <= 30
    monkeypatch.setattr(md, "MOST_NEWTON", 0)
    want = md.fit_ovr(df, "genres", labels, balanced)
    for label in labels:
        assert got[label].coefficients.toArray() == pytest.approx(want[label].coefficients.toArray(), rel=1e-3, abs=1e-4), label
        assert got[label].intercept == pytest.approx(want[label].intercept, rel=1e-3, abs=1e-4), label


def test_ablation_learns_each_column_once(spark, monkeypatch):
    """The same errors as with a preprocessor for each variant, from one."""
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), "xyz"[i % 3], float(a + 2 * (i % 3) + rng.normal())) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "a double, b double, c string, y double")
    columns, groups = prepare.Columns(["a", "b"], ["c"]), {"one": ["a"], "kind": ["c"]}
    want = {}
    for name, kept in {"all": columns, "without_one": columns.without(["a"]), "without_kind": columns.without(["c"])}.items():
        own = prepare.prepare(prepare.fit_preprocessor(df, kept), df)
        want[name] = md.rmse(models.linear(own).transform(own), "y", "prediction")
    fits, real = [], md.fit_preprocessor
    monkeypatch.setattr(md, "fit_preprocessor", lambda *a: fits.append(1) or real(*a))
    got = {r["variant"]: r["rmse"] for r in md.ablation(df, df, columns, groups, models.linear, "y").collect()}
    assert got == pytest.approx(want) and len(fits) == 1


def test_label_features_hold_nothing_of_the_genres():
    assert not {"genre_list", "genre_cnt"} & set(models.LABEL_FEATURES.all()) and {"genre_list", "genre_cnt"} <= set(models.FEATURES.all())


def test_quality_edges(spark):
    empty = spark.createDataFrame([], "v int, ingested_at timestamp_ntz")
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    assert dq.null_rate(empty, "v", 0.0, "c", "t").first()["passed"]
    stale = dq.freshness(empty, "ingested_at", now, 24, "c", "t").first()
    assert stale["metric_value"] == dq.NEVER_LOADED_HOURS and not stale["passed"]
    quarter = spark.createDataFrame([(1,), (2,), (3,), (None,)], "v int")
    at_limit = dq.null_rate(quarter, "v", 0.25, "c", "t")
    assert at_limit.first()["passed"]
    assert [(r["check_name"], r["passed"]) for r in dq.apply_alert(at_limit, 20).collect()] == [("c", False), ("c_alert", False)]
    assert [r["passed"] for r in dq.apply_alert(at_limit, 25).collect()] == [True]


def test_suite_survives_a_broken_check(spark):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    checks = [dq.Check("ok", "t", "null_rate", 0.0, options={"column": "v"}), dq.Check("bad", "t", "null_rate", 0.0, options={"column": "zz"}),
              dq.Check("odd", "t", "no such metric", 0.0)]
    got = {r["check_name"]: r["passed"] for r in dq.run_checks({"t": spark.createDataFrame([(1,)], "v int")}, checks, now, "b").collect()}
    assert got == {"ok": True, "bad": False, "odd": False}
