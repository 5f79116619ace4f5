"""Catalogue queries. Ids may be values or scalar columns; every ordering ends in a key, so pages are stable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.scalars import ilike_contains, split_list
from marquee.operators.joins import collaborators as shared_credits
from marquee.operators.ordering import one_per_group
from marquee.operators.paging import browse_sort, page, top_n, union_all

# Fixed values of the catalogue.
ON_SCREEN = ("actor", "actress", "self")
EPISODIC_TYPES = ("tvSeries", "tvMiniSeries", "tvMovie", "tvSpecial")
LISTED_TYPES = ("movie", "tvSeries", "tvMiniSeries")
TYPE_FAMILIES = (("movie", "short", "video"), ("tvSeries", "tvMiniSeries", "tvSpecial"))

SUMMARY = ["tconst", "primary_title", "title_type", "average_rating", "start_year", "num_votes", "genre_list"]


def by_id(df: DataFrame, column: str, wanted) -> DataFrame:
    return df.filter(F.col(column) == (wanted if isinstance(wanted, Column) else F.lit(wanted)))


def by_id_not(df: DataFrame, column: str, unwanted) -> DataFrame:
    return df.filter(F.col(column) != (unwanted if isinstance(unwanted, Column) else F.lit(unwanted)))


def title(titles: DataFrame, title_id) -> DataFrame:
    return by_id(titles, "tconst", title_id).withColumn("genres", split_list("genre_list"))


def _billed(principals: DataFrame, people: DataFrame, title_id) -> DataFrame:
    credits = by_id(principals, "title_key", title_id)
    return credits.join(people.select(F.col("nconst").alias("name_key"), "primary_name"), "name_key", "left")


BILLING = ["name_key", "primary_name", "character_name", "ordering", "category", "job"]


def billing_order() -> list[Column]:
    return [F.asc_nulls_last("ordering"), *[F.asc_nulls_last(c) for c in ("name_key", "category", "character_name", "job")]]


def cast(principals: DataFrame, people: DataFrame, title_id, n: int = 20) -> DataFrame:
    on_screen = _billed(principals, people, title_id).filter(F.col("category").isin(*ON_SCREEN))
    return top_n(on_screen.select(*BILLING), billing_order(), n)


def crew(principals: DataFrame, people: DataFrame, title_id) -> DataFrame:
    others = _billed(principals, people, title_id).filter(~F.col("category").isin(*ON_SCREEN))
    return others.select(*BILLING).drop("character_name").orderBy(
        F.asc_nulls_last("ordering"), *[F.asc_nulls_last(c) for c in ("name_key", "category", "job")]
    )


def similar(titles: DataFrame, title_id, n: int = 12, min_votes: int = 1000) -> DataFrame:
    """Well-voted titles of the same family that share one of the first three genres, one per name."""
    source = by_id(titles, "tconst", title_id).select("title_type", F.slice(split_list("genre_list"), 1, 3).alias("genres"))
    kind, genres = source.select("title_type").scalar(), source.select("genres").scalar()
    family = F.lit(list(LISTED_TYPES))
    for types in TYPE_FAMILIES:
        family = F.when(kind.isin(*types), F.lit(list(types))).otherwise(family)
    found = by_id_not(titles, "tconst", title_id).withColumn("_genres", split_list("genre_list"))
    found = found.filter(
        (F.col("num_votes") >= min_votes) & F.col("average_rating").isNotNull() & F.array_contains(family, F.col("title_type"))
        & ~F.array_contains("_genres", "Adult") & F.arrays_overlap("_genres", F.array_remove(genres, "Adult"))
    ).select(*SUMMARY)
    unique = one_per_group(found, ["primary_title"], [F.desc("num_votes"), F.asc("tconst")])
    return top_n(unique, [F.desc("average_rating"), F.desc("num_votes"), F.asc("tconst")], n)


def episodes(episodes_df: DataFrame, titles: DataFrame, title_id, n: int = 100) -> DataFrame:
    """Episodes of a title in order, empty unless its type is episodic."""
    series = by_id(titles, "tconst", title_id).filter(F.col("title_type").isin(*EPISODIC_TYPES)).select(F.col("tconst").alias("series_key"))
    found = by_id(episodes_df, "series_key", title_id).join(series, "series_key", "left_semi")
    listed = found.select("episode_key", "season_number", "episode_number").withColumnRenamed("episode_key", "tconst")
    summary = titles.select(*SUMMARY)
    order = [F.asc_nulls_last("season_number"), F.asc_nulls_last("episode_number"), F.asc("tconst")]
    return top_n(listed.join(summary, "tconst", "left"), order, n)


def filmography(performance: DataFrame, titles: DataFrame, person_id, n: int = 50) -> DataFrame:
    """Credits of a person, newest first."""
    credits = by_id(performance, "nconst", person_id).select("tconst", "category", "character_name")
    order = [F.desc_nulls_last("start_year"), F.asc("tconst"), F.asc("category"), F.asc_nulls_last("character_name")]
    return top_n(credits.join(titles.select(*SUMMARY), "tconst", "left"), order, n)


def known_for(people: DataFrame, titles: DataFrame, person_id, n: int = 10) -> DataFrame:
    """Titles a person is known for, in listed order: by id, or by the best-voted matching name if no id is found."""
    person = by_id(people, "nconst", person_id).filter("known_for_titles IS NOT NULL")
    listed_ids = split_list("known_for_ids") if "known_for_ids" in people.columns else F.array().cast("array<string>")
    ids = person.select(F.posexplode(listed_ids).alias("pos", "id"))
    listed = ids.select("pos", F.col("id").try_cast(titles.schema["tconst"].dataType).alias("tconst"))
    first = listed.groupBy("tconst").agg(F.min("pos").alias("pos"))
    exact = first.join(titles.select(*SUMMARY), "tconst").select("pos", *SUMMARY)
    names = person.select(F.posexplode(split_list("known_for_titles")).alias("pos", "_name"))
    # The names of one person are one short array, read as a scalar; used only where no id was found.
    missing = exact.agg(F.count("*")).scalar() == 0
    wanted = names.filter(missing).agg(F.collect_list(F.struct("pos", F.lower("_name").alias("name")))).scalar()
    hits = F.filter(F.col("_wanted"), lambda w: F.contains(F.lower("primary_title"), w["name"]))
    matched = titles.select(*SUMMARY).withColumn("_wanted", wanted).select(*SUMMARY, F.explode(hits["pos"]).alias("pos"))
    best = one_per_group(matched, ["pos"], [F.desc_nulls_last("num_votes"), F.asc("tconst")])
    best = one_per_group(best, ["tconst"], [F.asc("pos")]).select("pos", *SUMMARY)
    return top_n(exact.unionByName(best), [F.asc("pos")], n)


def collaborators(performance: DataFrame, people: DataFrame, person_id, n: int = 20) -> DataFrame:
    """People with the most shared credits. Counting comes first, names last."""
    known = people.select("nconst", "primary_name")
    counted = shared_credits(performance, person_id if isinstance(person_id, Column) else F.lit(person_id))
    return top_n(counted.join(known, "nconst"), [F.desc("collab_count"), F.asc("nconst")], n)


def person(people: DataFrame, performance: DataFrame, titles: DataFrame, person_id) -> DataFrame:
    """One row: the person with known-for titles, filmography and collaborators as arrays."""
    row = by_id(people, "nconst", person_id)

    def listed(df: DataFrame, rank: Column, *columns: str) -> Column:
        """A bounded list as an array of structs, sorted by ``rank`` and then by the columns."""
        return df.agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), *columns)))).scalar()

    newest_first = -F.coalesce("start_year", F.lit(0))
    return row.withColumns({
        "professions": split_list("profession_list"),
        "known_for": listed(known_for(people, titles, person_id), F.col("pos"), "tconst", "primary_title"),
        "filmography": listed(
            filmography(performance, titles, person_id), newest_first, "tconst", "category", "character_name", "start_year"
        ),
        "collaborators": listed(collaborators(performance, people, person_id), -F.col("collab_count"), "nconst"),
    })


def search(titles: DataFrame, text: str, first: int = 50, offset: int = 0) -> DataFrame:
    """Titles whose name contains the text, most voted first, with the total and the next offset."""
    found = titles.filter(ilike_contains("primary_title", text)).select(*SUMMARY)
    return page(found, browse_sort("votes"), first, offset)


def browse(
    titles: DataFrame, genres: Sequence[str] = (), decade: int | None = None, title_type: str | None = None,
    min_rating: float | None = None, sort: str | None = None, first: int = 100, offset: int = 0,
) -> DataFrame:
    """A page of titles; given conditions all apply, of the genres any one."""
    found = titles
    if genres:
        found = found.filter(F.arrays_overlap(split_list("genre_list"), F.lit(list(genres))))
    if decade:
        found = found.filter((F.col("start_year") >= decade) & (F.col("start_year") < decade + 10))
    if title_type:
        found = found.filter(F.col("title_type") == title_type)
    if min_rating is not None:
        found = found.filter(F.col("average_rating") >= min_rating)
    return page(found.select(*SUMMARY), browse_sort(sort), first, offset)


def _listed(titles: DataFrame, min_votes: int) -> DataFrame:
    return titles.filter(
        F.col("average_rating").isNotNull() & (F.col("num_votes") > min_votes) & F.col("title_type").isin(*LISTED_TYPES)
    ).select(*SUMMARY)


def trending(titles: DataFrame, n: int = 20) -> DataFrame:
    order = [F.desc("num_votes"), F.asc("tconst")]
    return top_n(one_per_group(_listed(titles, 100), ["primary_title"], order), order, n)


def top_rated(titles: DataFrame, n: int = 20) -> DataFrame:
    order = [F.desc("average_rating"), F.desc("num_votes"), F.asc("tconst")]
    return top_n(one_per_group(_listed(titles, 1000), ["primary_title"], order), order, n)


def homepage(titles: DataFrame, n: int = 20, featured: int = 10) -> DataFrame:
    """The three lists of the start page, tagged by section."""
    sections = {"trending": trending(titles, n), "top_rated": top_rated(titles, n), "featured": trending(titles, featured)}
    return union_all([df.withColumn("section", F.lit(name)) for name, df in sections.items()])


def rating_history(ratings: DataFrame, title_id, days: int | None = None, n: int = 100) -> DataFrame:
    """Rated snapshots of a title, newest first; ``days`` counts back from the newest snapshot of all."""
    rows = by_id(ratings, "title_key", title_id).filter("average_rating IS NOT NULL")
    if days is not None:
        newest = ratings.agg(F.max("snapshot_date")).scalar()
        rows = rows.filter(F.col("snapshot_date") > F.date_sub(newest, days))
    return top_n(rows.select("snapshot_date", "average_rating", "num_votes"), [F.desc("snapshot_date")], n)


def search_person(people: DataFrame, text: str, n: int = 20) -> DataFrame:
    return top_n(people.filter(ilike_contains("primary_name", text)), [F.asc("primary_name"), F.asc("nconst")], n)


def list_titles(
    titles: DataFrame, text: str | None = None, title_type: str | None = None, genre: str | None = None,
    year_from: int | None = None, year_to: int | None = None, sort: str = "votes", number: int = 1, per_page: int = 20,
) -> DataFrame:
    """Page ``number`` (from 1) of the titles that meet all conditions; the year range is applied before paging."""
    found = titles
    if text:
        found = found.filter(ilike_contains("primary_title", text))
    if title_type:
        found = found.filter(F.col("title_type") == title_type)
    if genre:
        found = found.filter(F.array_contains(split_list("genre_list"), genre))
    if year_from is not None:
        found = found.filter(F.col("start_year") >= year_from)
    if year_to is not None:
        found = found.filter(F.col("start_year") <= year_to)
    return page(found.select(*SUMMARY), browse_sort(sort), per_page, (number - 1) * per_page)


def principals(principals_df: DataFrame, people: DataFrame, title_id, n: int = 100) -> DataFrame:
    """Cast, then crew, in one list."""
    on_screen = cast(principals_df, people, title_id, n).drop("character_name").withColumn("part", F.lit("cast"))
    return on_screen.unionByName(crew(principals_df, people, title_id).withColumn("part", F.lit("crew")))


def title_detail(titles: DataFrame, principals_df: DataFrame, people: DataFrame, title_id) -> DataFrame:
    """One title with alphabetical, de-duplicated director and writer names and its number of principals."""
    billed = _billed(principals_df, people, title_id)
    names = lambda role: F.array_sort(F.collect_set(F.when(F.col("category") == role, F.col("primary_name"))))
    credits = billed.groupBy(F.col("title_key").alias("tconst")).agg(
        F.array_join(names("director"), ", ").alias("directors"), F.array_join(names("writer"), ", ").alias("writers"),
        F.count("*").alias("principals"),
    )
    return by_id(titles, "tconst", title_id).select(*SUMMARY, "runtime_minutes").join(credits, "tconst", "left")


def search_all(titles: DataFrame, people: DataFrame, text: str, kind: str = "all", n: int = 20) -> DataFrame:
    """(kind, id, name) of matching titles, then people."""
    parts = []
    if kind in ("all", "titles"):
        found = search(titles, text, n)
        parts.append(found.select(F.lit("title").alias("kind"), F.col("tconst").alias("id"), F.col("primary_title").alias("name")))
    if kind in ("all", "people"):
        found = search_person(people, text, n)
        parts.append(found.select(F.lit("person").alias("kind"), F.col("nconst").alias("id"), F.col("primary_name").alias("name")))
    return union_all(parts)
