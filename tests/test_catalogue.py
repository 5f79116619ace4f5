"""Catalogue queries on a two-title fixture and edge cases."""

import pytest
from pyspark.sql import functions as F

from marquee.plans import catalogue as cat
from marquee.plans import marts


@pytest.fixture
def titles(spark):
    return spark.createDataFrame(
        [("tt100", "Shawshank", "movie", 9.3, 1994, 2_800_000, "Drama"), ("tt200", "Matrix", "movie", 8.7, 1999, 2_000_000, "Action, Sci-Fi")],
        "tconst string, primary_title string, title_type string, average_rating double, start_year int, num_votes int, genre_list string",
    )


def known(spark, titles, **columns):
    shape = ", ".join(f"{c} string" for c in ["nconst", "primary_name", *columns])
    people = spark.createDataFrame([("nm1", "Someone", *columns.values())], shape)
    return [r["tconst"] for r in cat.known_for(people, titles, "nm1").orderBy("pos").collect()]


def test_known_for_ids_keep_their_order(spark, titles):
    assert known(spark, titles, known_for_titles="Matrix, Shawshank", known_for_ids="tt200,tt100") == ["tt200", "tt100"]


def test_known_for_falls_back_to_names(spark, titles):
    assert known(spark, titles, known_for_titles="matrix") == ["tt200"]
    assert known(spark, titles, known_for_titles="matrix", known_for_ids="tt999") == ["tt200"]
    assert known(spark, titles, known_for_titles=None, known_for_ids="tt100") == []
    assert known(spark, titles, known_for_titles="%", known_for_ids="") == []


def test_similar_uses_whole_genres(spark):
    shape = "tconst int, primary_title string, title_type string, average_rating double, start_year int, num_votes int, genre_list string"
    rows = [
        (1, "Source", "movie", 5.0, 2000, 10, "Music, Adult"), (2, "Musical one", "movie", 9.0, 2000, 5000, "Musical"),
        (3, "Music one", "short", 8.0, 2000, 5000, "Music"), (4, "Music one", "video", 7.0, 2000, 9000, "Drama, Music"),
        (5, "Series", "tvSeries", 9.9, 2000, 5000, "Music"), (6, "Too few", "movie", 9.9, 2000, 999, "Music"),
        (7, "Adult one", "movie", 9.9, 2000, 5000, "Music, Adult"),
    ]
    titles = spark.createDataFrame(rows, shape)
    assert [r["tconst"] for r in cat.similar(titles, 1).collect()] == [4]
    assert cat.similar(titles, 12345).count() == 0


def test_episodes_only_of_episodic_types(spark):
    titles = spark.createDataFrame(
        [(1, "S", "tvSeries", 1.0, 2000, 1, "x"), (2, "M", "movie", 1.0, 2000, 1, "x"), (3, "E", "tvEpisode", 1.0, 2000, 1, "x")],
        "tconst int, primary_title string, title_type string, average_rating double, start_year int, num_votes int, genre_list string")
    episodes = spark.createDataFrame([(3, 1, 1, None), (9, 1, 1, 1), (3, 2, 1, 1)], "episode_key int, series_key int, season_number int, episode_number int")
    assert [(r["tconst"], r["primary_title"]) for r in cat.episodes(episodes, titles, 1).collect()] == [(9, None), (3, "E")]
    assert cat.episodes(episodes, titles, 2).count() == 0


def test_year_range_applies_before_paging(spark):
    titles = spark.range(100).select(
        F.col("id").alias("tconst"), F.lit("t").alias("primary_title"), F.lit("movie").alias("title_type"), F.lit(5.0).alias("average_rating"),
        (1950 + F.col("id")).cast("int").alias("start_year"), F.col("id").alias("num_votes"), F.lit("Drama").alias("genre_list"))
    page = cat.list_titles(titles, year_from=2000, year_to=2024, number=2, per_page=20).collect()
    assert [r["start_year"] for r in page] == [2004, 2003, 2002, 2001, 2000] and page[0]["total"] == 25 and page[0]["next_offset"] is None


def test_cooccurrence_ranks_and_hot_pairs(spark):
    credits = [(t, p, "actor") for t in range(60) for p in (1, 2)] + [(0, 1, "actress"), (1, 3, "actor"), (2, 4, "director")]
    performance = spark.createDataFrame(credits, "tconst int, nconst int, category string")
    titles = spark.createDataFrame([(t, "movie", 2000, 5.0, None if t % 4 == 0 else t % 10) for t in range(60)],
                                   "tconst int, title_type string, start_year int, average_rating double, num_votes int")
    people = spark.createDataFrame([(1, "A"), (2, "B")], "nconst int, primary_name string")
    read = lambda hot, block: sorted((r["actor_a_nconst"], r["actor_b_nconst"], r["collaboration_rank"], r["shared_title"], r["total_collaborations"])
                              for r in marts.actor_cooccurrence(performance, titles, people, hot_rows=hot, block_rows=block).collect())
    plain, sliced = read(10**6, 5000), read(10, 1)
    assert plain == sliced
    pair = [r for r in plain if r[:2] == (1, 2)]
    assert len(pair) == 60 and all(r[4] == 60 for r in pair)
    assert pair[0][3] == 9 and pair[-1][3] == 56  # most votes first, then unvoted titles last
    assert (1, 3, 1, 1, 1) in plain


def test_incremental_principals(spark):
    principal = spark.createDataFrame([(1, 1, 5, "actor", None, "b", "2024-01-01"), (2, 1, 6, "actor", None, "b", "2024-02-01")],
                                      "tconst int, ordering int, nconst int, category string, job string, batch_id string, ingested_at string")
    chars = spark.createDataFrame([(2, 1, "Z"), (2, 1, "A")], "tconst int, ordering int, character_name string")
    target = spark.createDataFrame([("2024-01-01",)], "ingested_at string")
    new = marts.fact_title_principal(principal, chars, target).collect()
    assert [(r["title_key"], r["character_name"]) for r in new] == [(2, "A, Z")]
    assert marts.fact_title_principal(principal, chars, target.limit(0)).count() == 2
