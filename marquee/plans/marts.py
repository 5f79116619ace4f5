"""Star-schema marts built from the normalised tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.scalars import (
    age_at_death,
    audit_defaults,
    generation,
    popularity_segment,
    rating_bucket,
)
from marquee.operators.aggregates import aka_summary
from marquee.operators.joins import assemble, episodes_with_series, latest_snapshot, ordered_concat, pairs
from marquee.operators.ordering import HOT_ROWS
from marquee.operators.paging import union_all
from marquee.operators.windows import collaboration_rank

ACTING = ("actor", "actress")


def current(df: DataFrame) -> DataFrame:
    return df.filter("is_current")


def _credited_names(credits: Mapping[str, DataFrame], names: DataFrame) -> DataFrame:
    """Names of each role in billing order, a column per role, null without any; credits of unknown people are left out.

    All roles meet the people in one join and the titles in one aggregate.
    """
    every = [df.select("tconst", "nconst", "ordering", F.lit(role).alias("_role")) for role, df in credits.items()]
    known = current(names).filter("primary_name IS NOT NULL").select("nconst", "primary_name")
    named = union_all(every).join(known, "nconst")
    listed = lambda role: F.array_sort(F.collect_list(F.when(F.col("_role") == role, F.struct("ordering", "primary_name"))))
    gathered = named.groupBy("tconst").agg(*[listed(role).alias(role) for role in credits])
    return gathered.select("tconst", *[F.when(F.size(role) > 0, F.array_join(F.col(role)["primary_name"], ", ")).alias(role) for role in credits])


def title_details(
    basics: DataFrame, genre: DataFrame, akas: DataFrame, director: DataFrame, writer: DataFrame,
    names: DataFrame, rating: DataFrame, episode: DataFrame,
) -> DataFrame:
    """Current titles with everything known about them. Every side has one row per title."""
    base = current(basics).drop("is_current", "genres")
    genres = ordered_concat(genre, ["tconst"], "genre", ["genre"], "genre_list")
    ratings = latest_snapshot(rating).select("tconst", "average_rating", "num_votes")
    episodes = episodes_with_series(episode, basics).select(
        "tconst", "parent_tconst", "series_title", "season_number", "episode_number"
    )
    regions = aka_summary(akas).withColumnRenamed("title_id", "tconst")
    sides = [
        genres,
        _credited_names({"director_names": director, "writer_names": writer}, names),
        ratings,
        episodes,
        regions,
    ]
    return assemble(base, sides, "tconst")


def dim_title(*tables: DataFrame) -> DataFrame:
    """Title dimension; takes the inputs of :func:`title_details`."""
    details = title_details(*tables)
    return details.select(
        "tconst", "title_type", "primary_title", "original_title", "is_adult", "start_year", "end_year",
        "runtime_minutes", "genre_list", "director_names", "writer_names", "average_rating", "num_votes",
        popularity_segment("num_votes").alias("popularity_segment"),
        rating_bucket("average_rating").alias("rating_bucket"),
        "parent_tconst", "series_title", "season_number", "episode_number",
        "region_list", "language_list", "aka_count", "aka_rows",
    )


def dim_person(names: DataFrame, profession: DataFrame, known_for: DataFrame, basics: DataFrame) -> DataFrame:
    """Person dimension. ``known_for`` has (nconst, tconst, known_for_order)."""
    people = current(names).select("nconst", "primary_name", "birth_year", "death_year")
    titles = current(basics).select("tconst", "primary_title")
    professions = ordered_concat(profession, ["nconst"], "profession", ["profession_order"], "profession_list")
    known = known_for.join(titles, "tconst", "left")
    item = F.struct("known_for_order", "tconst", "primary_title")
    listed = known.groupBy("nconst").agg(F.array_sort(F.collect_list(item)).alias("items"))
    named = F.filter("items", lambda i: i["primary_title"].isNotNull())
    known_lists = listed.select(
        "nconst",
        F.when(F.size(named) > 0, F.array_join(named["primary_title"], ", ")).alias("known_for_titles"),
        F.array_join(F.col("items.tconst").cast("array<string>"), ",").alias("known_for_ids"),
    )
    return assemble(people, [professions, known_lists], "nconst").select(
        "nconst", "primary_name", "birth_year", "death_year",
        age_at_death("birth_year", "death_year").alias("age_at_death"),
        generation("birth_year").alias("generation"),
        "profession_list", "known_for_titles", "known_for_ids",
    )


def fact_title_rating(rating: DataFrame) -> DataFrame:
    return rating.select(
        F.col("tconst").alias("title_key"), "snapshot_date", "average_rating", "num_votes", "batch_id", "ingested_at"
    )


def fact_title_principal(principal: DataFrame, chars: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """One row per principal with its characters in one text.

    With ``target`` only rows ingested after the newest one there are built.
    """
    if target is not None:
        newest = target.agg(F.max("ingested_at")).scalar()
        principal = principal.filter(newest.isNull() | (F.col("ingested_at") > newest))
    names = ordered_concat(chars, ["tconst", "ordering"], "character_name", ["character_name"], "character_names")
    return principal.join(names, ["tconst", "ordering"], "left").select(
        F.col("tconst").alias("title_key"), F.col("nconst").alias("name_key"),
        F.col("character_names").alias("character_name"), "ordering", "category", "job", "batch_id", "ingested_at",
    )


def fact_performance(principal: DataFrame, chars: DataFrame) -> DataFrame:
    """One row per principal and character."""
    expanded = principal.drop("characters").join(chars, ["tconst", "ordering"], "left")
    return audit_defaults(expanded).select(
        "tconst", "ordering", "nconst", "category", "job", "character_name", "batch_id", "ingested_at"
    )


def fact_episode(episode: DataFrame, basics: DataFrame) -> DataFrame:
    return episodes_with_series(episode, basics).select(
        F.col("tconst").alias("episode_key"), F.col("parent_tconst").alias("series_key"),
        "season_number", "episode_number", "series_title", "series_start_year", "series_type", "batch_id", "ingested_at",
    )


def actor_cooccurrence(
    performance: DataFrame, titles: DataFrame, people: DataFrame, roles: Sequence[str] = ACTING, hot_rows: int = HOT_ROWS,
    block_rows: int = 5_000,
) -> DataFrame:
    """Each pair of performers with each title they share, its rank within the pair and the pair's total.

    The mart is one row per pair and title by definition. Repeated credits go first; names and title columns are
    joined to the credits, so the far larger pairs are shuffled only for their ranks. Two bounds are read
    from the credit counts beforehand: the largest cast tells whether a title must be paired in blocks, and the
    busiest person, whom no pair can exceed, whether a pair must be ranked in slices.
    """
    acted = performance.filter(F.col("category").isin(list(roles))).select("tconst", "nconst")
    bounds = [acted.groupBy(c).count().agg(F.max("count").alias("n"), F.lit(c).alias("key")) for c in ("nconst", "tconst")]
    largest = {r["key"]: r["n"] or 0 for r in bounds[0].unionAll(bounds[1]).collect()}  # two rows
    names = people.select("nconst", F.col("primary_name").alias("name"))
    title = titles.select("tconst", "title_type", "start_year", "average_rating", "num_votes")
    credits = acted.distinct().join(names, "nconst", "left").join(title, "tconst", "left")
    shared = pairs(
        credits, "tconst", "nconst", keep=title.columns[1:], both=["name"], largest=largest["tconst"], block_rows=block_rows
    )
    ranked = collaboration_rank(
        shared, ["nconst_a", "nconst_b"], "num_votes", "tconst", hot_rows=hot_rows, largest=largest["nconst"], total="total_collaborations"
    )
    return ranked.select(
        F.col("nconst_a").alias("actor_a_nconst"), F.col("name_a").alias("actor_a_name"), F.col("nconst_b").alias("actor_b_nconst"),
        F.col("name_b").alias("actor_b_name"), F.col("tconst").alias("shared_title"), "title_type", "start_year", "average_rating",
        "num_votes", "collaboration_rank", "total_collaborations",
    )
