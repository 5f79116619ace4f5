"""Scalars and list columns."""

import pytest
from pyspark.sql import functions as F

from marquee.functions import scalars as sc
from marquee.operators import normalize as nz


def test_clean_fill_flag_require(spark, rows):
    df = spark.createDataFrame([("a", "1"), ("\\N", "\\N"), ("", None), (None, "0")], "k string, f string")
    assert rows(sc.clean_nulls(df), "k") == rows(spark.createDataFrame([("a",), (None,), ("",), (None,)], "k string"))
    assert [r[0] for r in df.select(sc.to_flag("f")).collect()] == [True, False, False, False]
    ok, bad = sc.require(df, "k")
    assert [r["k"] for r in ok.collect()] == ["a"]
    assert bad.count() == 3
    assert sc.fill_defaults(df, {"f": "x"}).filter("f = 'x'").count() == 1


def test_cast_keeps_bad_text_as_null(spark):
    df = spark.createDataFrame([("12",), ("x",), (None,)], "v string")
    assert [r[0] for r in sc.cast_columns(df, {"v": "int"}).collect()] == [12, None, None]


@pytest.mark.parametrize("votes, label", [(None, "unknown"), (0, "low"), (9999, "low"), (10_000, "medium"), (100_000, "high")])
def test_popularity(spark, votes, label):
    df = spark.createDataFrame([(votes,)], "v bigint")
    assert df.select(sc.popularity_segment("v")).first()[0] == label


@pytest.mark.parametrize("rating, label", [(None, "unrated"), (5.9, "average"), (6.0, "good"), (8.0, "excellent")])
def test_rating_bucket(spark, rating, label):
    df = spark.createDataFrame([(rating,)], "v double")
    assert df.select(sc.rating_bucket("v")).first()[0] == label


def test_generation_and_age(spark):
    years = [(2010, None), (1997, 2020), (1981, None), (1965, None), (1946, None), (1900, 1980), (None, 1990)]
    df = spark.createDataFrame(years, "b int, d int")
    got = [tuple(r) for r in df.select(sc.generation("b"), sc.age_at_death("b", "d")).collect()]
    assert got == [
        ("Gen Alpha", None), ("Gen Z", 23), ("Millennial", None), ("Gen X", None), ("Boomer", None), ("Silent/Greatest", 80), (None, None),
    ]


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("100% Fun",), ("1000 Funs",), ("a_b",), ("axb",), ("c\\d",)], "t string")
    hits = lambda text: [r[0] for r in df.filter(sc.ilike_contains("t", text)).collect()]
    assert hits("100% f") == ["100% Fun"]
    assert hits("A_B") == ["a_b"]
    assert hits("c\\D") == ["c\\d"]


def test_split_and_size(spark):
    df = spark.createDataFrame([("Drama, Crime,,War ",), ("",), (None,)], "g string")
    got = [tuple(r) for r in df.select(sc.split_list("g"), sc.list_size("g"), sc.list_size("g", null_as=0)).collect()]
    assert got == [(["Drama", "Crime", "War"], 4, 4), ([], 1, 1), (None, 1, 0)]


def test_split_keeps_last_character(spark):
    """An item's position must not leak into the trim characters."""
    df = spark.createDataFrame([("Role 0,Role 1",)], "g string")
    assert df.select(sc.split_list("g")).first()[0] == ["Role 0", "Role 1"]


def test_title_class_nonfiction_wins(spark):
    df = spark.createDataFrame([(["Drama", "News"],), (["Drama"],), (["Music"],), (None,)], "g array<string>")
    assert [r[0] for r in df.select(sc.title_class("g")).collect()] == ["Non-fiction", "Fiction", "Other", "Other"]


def test_attr_hash_separator(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, ""), ("", None)], "x string, y string")
    plain = [r[0] for r in df.select(sc.attr_hash(["x", "y"])).collect()]
    escaped = [r[0] for r in df.select(sc.attr_hash(["x", "y"], escape=True)).collect()]
    assert plain[0] == plain[1] and escaped[0] != escaped[1]
    assert plain[2] == plain[3]


def test_ordered_explode(spark, rows):
    df = spark.createDataFrame([(1, "nm1,nm2"), (2, "\\N"), (3, ""), (4, None), (5, "nm1,,nm1")], "t int, l string")
    assert rows(nz.normalize_ordered(df, ["t"], "l", "n")) == [(1, "nm1", 1), (1, "nm2", 2), (5, "nm1", 1), (5, "nm1", 3)]
    assert rows(nz.normalize_set(df, ["t"], "l", "n")) == [(1, "nm1"), (1, "nm2"), (5, "nm1")]


@pytest.mark.parametrize("strict", [False, True])
def test_character_list(spark, rows, strict):
    df = spark.createDataFrame(
        [(1, '["A","B"]'), (2, '["A"]'), (3, '["Self, as host"]'), (4, '["A","A"]'), (5, "\\N"), (6, None)], "t int, c string"
    )
    assert rows(nz.normalize_json_list(df, ["t"], "c", "n", strict=strict)) == [
        (1, "A"), (1, "B"), (2, "A"), (3, "Self, as host"), (4, "A"),
    ]


def test_explode_zip_pads(spark, rows):
    df = spark.createDataFrame([("en, de", "US"), (None, "FR")], "l string, r string")
    assert rows(nz.explode_zip(df, "l", "r")) == [("de", None), ("en", "US"), (None, "FR")]


def test_multi_hot_ignores_unseen(spark):
    from pyspark.ml.functions import vector_to_array

    df = spark.createDataFrame([(1, "a, b", 2000), (2, "b, c", 2020), (3, None, 2020)], "k int, g string, y int")
    coded, model = nz.multi_hot(df, "g", F.col("y") <= 2014)
    assert sorted(model.vocabulary) == ["a", "b"]
    ones = {r["k"]: sum(r["v"]) for r in coded.select("k", vector_to_array("features").alias("v")).collect()}
    assert ones == {1: 2, 2: 1, 3: 0}
