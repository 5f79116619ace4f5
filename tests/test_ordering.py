"""Skew-safe ranks, positions and quantiles against plain computations, hot groups included."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee.operators import aggregates as ag
from marquee.operators import joins, ordering, paging, windows


@pytest.fixture
def skewed(spark):
    """A third of all rows belongs to one pair; many equal and missing votes."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 17 + 1).alias("a"), (F.col("id") * 0).alias("b"), F.col("id").alias("t"),
        F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 7).alias("votes"),
    )
    return df


@pytest.mark.parametrize("hot_rows", [50, 10**9])
def test_rank_matches_row_number(skewed, hot_rows):
    ranked = windows.collaboration_rank(skewed, ["a", "b"], "votes", "t", name="r", hot_rows=hot_rows)
    plain = Window.partitionBy("a", "b").orderBy(F.desc_nulls_last("votes"), "t")
    both = ranked.withColumn("want", F.row_number().over(plain))
    assert both.count() == 3000
    assert both.filter("r <> want").count() == 0


def test_rank_without_keys(skewed):
    ranked = ordering.rank_within(skewed, [], [F.coalesce("votes", F.lit(99)), "t"], "r", hot_rows=100)
    got = [r["t"] for r in ranked.orderBy("r").collect()]
    want = [r["t"] for r in skewed.orderBy(F.coalesce("votes", F.lit(99)), "t").collect()]
    assert got == want


def test_dense_index(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), (F.col("id") * 7919 % 400).cast("string")).alias("k")).unionAll(
        spark.createDataFrame([(None,)], "k string")
    )
    got = {r["k"]: r["i"] for r in ordering.dense_index(df, "k", "i").collect()}
    assert got == {k: i for i, k in enumerate(sorted(f"k{i * 7919 % 400}" for i in range(400)))}


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_quantiles_match_numpy(spark, keys):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 2, 4000), np.full(2000, 7.0)])
    df = spark.createDataFrame([(i % 3, float(v)) for i, v in enumerate(values)], "g int, v double").unionAll(
        spark.createDataFrame([(0, None)], "g int, v double")
    )
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    found = ordering.exact_quantiles(df, "v", probs, keys).collect()
    for r in found:
        mine = values if not keys else values[r["g"] :: 3]
        assert r["n"] == len(mine)
        np.testing.assert_allclose([r[f"q{i}"] for i in range(5)], np.quantile(mine, probs), rtol=1e-12)
    assert len(found) == (3 if keys else 1)


def test_quantiles_keep_the_null_group_and_common_values(spark):
    values = [7.0] * 900 + [float(i) for i in range(100)]
    rows = [(g, v) for g in (None, "a") for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.01, 0.5, 0.99]
    found = {r["g"]: [r["q0"], r["q1"], r["q2"], r["n"]] for r in ordering.exact_quantiles(df, "v", probs, ["g"]).collect()}
    want = [*np.quantile(values, probs), 1000]
    assert set(found) == {None, "a"}
    for got in found.values():
        np.testing.assert_allclose(got, want, rtol=1e-12)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_quantiles_by_digits_equal_sorting(spark, limit):
    rng = np.random.default_rng(8)
    groups = {
        None: rng.normal(size=300), "near": 1.7e9 + rng.random(400), "wide": rng.choice([-1, 1], 300) * 10.0 ** rng.uniform(-320, 308, 300),
        "few": rng.choice([-0.0, 0.0, 1.5, -2.0], 50), "one": np.array([3.0]), "edge": np.array([2.0**k for k in range(-1074, 1024, 7)] + [np.nextafter(2.0**k, 0) for k in range(-1000, 1000, 50)]),
    }
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values] + [("near", None)], "g string, v double").repartition(5)
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    found = {r["g"]: r for r in ordering.exact_quantiles(df, "v", probs, ["g"], sorted_values=limit).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        ordered, pos = np.sort(values), np.array(probs) * (len(values) - 1)
        low, high = ordered[np.floor(pos).astype(int)], ordered[np.ceil(pos).astype(int)]
        want = low + (high - low) * (pos - np.floor(pos))
        np.testing.assert_allclose([found[g][f"q{i}"] for i in range(5)], want, rtol=1e-12, atol=0)
        assert found[g]["n"] == len(values)
    whole = spark.range(1000).select((F.col("id") * F.col("id") - 5000).alias("v"))
    assert ordering.exact_quantiles(whole, "v", [0.5], sorted_values=limit).first()["q0"] == (499**2 + 500**2) / 2 - 5000
    assert ordering.exact_quantiles(whole.limit(0), "v", [0.5], sorted_values=limit).count() == 0


def test_order_key_is_the_bit_pattern(spark):
    values = [0.0, 5e-324, 2.0**-1022, 1.0, float(np.nextafter(1.0, 2)), 0.1, 1e300, 1.7976931348623157e308, float("inf"), -3.5, -5e-324]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bits = [int(np.array(abs(v)).view("int64")) * (-1 if v < 0 else 1) for v in values]
    assert [r[0] for r in df.select(ordering.order_key(F.col("v"), False)).collect()] == bits


def test_a_hot_null_group_is_sliced(spark):
    df = spark.range(600).selectExpr("CASE WHEN id < 500 THEN NULL ELSE 'b' END AS g", "id AS v")
    ranked = ordering.rank_within(df, ["g"], ["v"], "r", hot_rows=100, total="n").collect()
    assert sorted((r["g"] is None, r["r"], r["n"]) for r in ranked) == sorted(
        [(True, i + 1, 500) for i in range(500)] + [(False, i + 1, 100) for i in range(100)]
    )
    counted = ordering.over_groups(df, ["g"], {"n": F.count("*")}, hot_rows=100)
    assert sorted({(r["g"] is None, r["n"]) for r in counted.collect()}) == [(False, 100), (True, 500)]


def test_slices_follow_the_session(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3000")
        assert ordering.slices(spark) == 4096
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ordering.slices(spark) == 64


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i), 5.0, None) for i in range(41)], "v double, c double, n double")
    got = {(r["feature"], r["bin"]): r["n"] for r in ag.histograms(df, ["v", "c", "n"]).collect()}
    assert got[("v", 20)] == 3  # 38, 39 and the maximum
    assert got[("v", 1)] == 2
    assert sum(n for (f, _), n in got.items() if f == "c") == 41
    probs = [r["prob"] for r in ag.histograms(df, ["n"]).collect()]
    assert len(probs) == 20 and all(abs(p - 0.05) < 1e-12 for p in probs)


def test_histogram_matches_numpy(spark):
    values = np.random.default_rng(3).normal(size=500)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r["n"] for r in ag.histograms(df, ["v"]).orderBy("bin").collect()]
    assert got == np.histogram(values, bins=20)[0].tolist()


def test_survival(spark):
    df = spark.createDataFrame([("a", 0), ("a", 2), ("a", 70), ("b", 1)], "g string, n int")
    got = {(r["g"], r["t"]): r["survival"] for r in ag.survival_curve(df, "g", "n", 60).collect()}
    assert got[("a", 1)] == pytest.approx(2 / 3) and got[("a", 2)] == pytest.approx(1 / 3) and got[("a", 60)] == pytest.approx(1 / 3)
    assert got[("b", 1)] == 0 and len(got) == 120


def test_career_windows(spark, rows):
    """Two credits in one year; gaps of exactly five and of six years."""
    df = spark.createDataFrame([("p", y) for y in (2000, 2000, 2005, 2011)], "n string, y int")
    assert rows(windows.cumulative_credits(df, ["n"], "y")) == [("p", 2000, 1), ("p", 2000, 2), ("p", 2005, 3), ("p", 2011, 4)]
    assert rows(windows.recent_credits(df, ["n"], "y", 5)) == [("p", 2000, 2), ("p", 2000, 2), ("p", 2005, 3), ("p", 2011, 1)]


@pytest.mark.parametrize("hot_rows", [50, 10**9])
def test_group_values_on_rows(skewed, hot_rows):
    found = windows.partition_total(windows.debut_year(skewed, ["a"], "t", hot_rows=hot_rows), ["a", "votes"], "n", hot_rows=hot_rows)
    plain = found.withColumn("m", F.min("t").over(Window.partitionBy("a"))).withColumn("k", F.count("*").over(Window.partitionBy("a", "votes")))
    assert found.count() == 3000 and plain.filter("debut_year <> m OR (n <> k AND votes IS NOT NULL)").isEmpty()


@pytest.mark.parametrize("limit", [0, 30, 10**6])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_to_hot_keys(spark, rows, limit, how):
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("x"))
    sizes = left.filter("k <> 4").groupBy("k").agg(F.count("*").alias("n"))
    found = joins.join_unique(left, sizes, ["k"], hot=F.col("n") > limit, how=how)
    assert rows(found) == rows(left.join(sizes, "k", how).select("k", "x", "n"))


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_pairs_in_blocks(spark, rows, block_rows):
    """One large group and small ones; each pair comes once, with its group's and its items' columns."""
    members = [(0, i) for i in range(30)] + [(g, i) for g in (1, 2) for i in range(3)]
    df = spark.createDataFrame([(g, i, f"g{g}", f"i{i}") for g, i in members], "g int, n int, title string, name string")
    got = rows(joins.pairs(df, "g", "n", keep=["title"], both=["name"], block_rows=block_rows), "g", "title", "n_a", "name_a", "n_b", "name_b")
    want = sorted(((g, f"g{g}", i, f"i{i}", j, f"i{j}") for g, i in members for h, j in members if g == h and i < j), key=repr)
    assert got == want


def test_role_pairs_pruning_is_exact(spark, rows):
    credits = [(t, p, "w") for t in range(6) for p in (1, 2, t + 10)] + [(t, p, "d") for t in range(6) for p in (5, t + 50)]
    df = spark.createDataFrame(credits, "tconst int, nconst int, category string")
    total = lambda m: rows(
        joins.role_pairs(df, "w", "d", m).groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= 3))
    assert total(1) == total(3) == [(1, 5, 6), (2, 5, 6)]


def test_page_and_last_page(spark):
    df = spark.range(25).select(F.col("id").alias("tconst"))
    first = paging.page(df, [F.asc("tconst")], 10, 10).collect()
    assert [r["tconst"] for r in first] == list(range(10, 20)) and first[0]["total"] == 25 and first[0]["next_offset"] == 20
    assert paging.page(df, [F.asc("tconst")], 10, 20).first()["next_offset"] is None


def test_merge_unique_prefers_earlier(spark, rows):
    a = spark.createDataFrame([(1, "a")], "k int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert rows(paging.merge_unique([a, b], "k")) == [(1, "a"), (2, "b")]


def test_long_runs_come_in_pieces(spark, rows):
    df = spark.createDataFrame([("a", 7), ("b", 1), ("c", 0), ("d", 6)], "k string, n bigint")
    want = sorted(((k, i) for k, n in (("a", 7), ("b", 1), ("d", 6)) for i in range(1, n + 1)), key=repr)
    assert rows(windows.explode_run(df, ["k"], "n", "i", run=3), "k", "i") == want
