"""Exploratory analytics on the marts, one function per question. Results are the tables behind the charts.

People are grouped by id and carry their name; ``by_name=True`` groups namesakes together instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.scalars import (
    decade,
    genre_class,
    has_item,
    popularity_segment,
    quadrant,
    split_list,
    title_class,
    weighted_rating,
)
from marquee.operators.aggregates import (
    arg_max,
    histograms,
    pivot_matrix,
    proportion,
    restrict_to_top,
    survival_curve,
    top_categories,
    trim_quantiles,
)
from marquee.operators.features import dated_credits
from marquee.operators.joins import cross_scalar, role_pairs
from marquee.operators.ordering import exact_quantiles
from marquee.operators.paging import top_n
from marquee.session import shared_dir

QUARTILES = [0.25, 0.5, 0.75]
PLOTTED_TYPES = ["movie", "tvSeries", "tvMiniSeries", "short", "video", "tvEpisode"]
CLASSES = ["Fiction", "Non-fiction", "Other"]


def rows() -> Column:
    return F.count(F.lit(1))  # a pivot takes no star


def genres_of(titles: DataFrame, *columns: str, source: str = "genre_list", name: str = "genre") -> DataFrame:
    """One row per title and trimmed item of a list column."""
    return titles.select(*columns, F.explode(split_list(source)).alias(name))


def quartiles(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Box-plot numbers of a column per group, nulls left out."""
    kind = df.schema[column].dataType
    found = exact_quantiles(df, column, [0.0, *QUARTILES, 1.0], keys)
    ends = [F.col(c).cast(kind).alias(name) for c, name in (("q0", "low"), ("q4", "high"))]
    return found.select(*keys, ends[0], "q1", "q2", "q3", ends[1], "n")


# Titles and genres


def titles_per_genre(titles: DataFrame) -> DataFrame:
    return genres_of(titles).groupBy("genre").agg(rows().alias("title_cnt"))


def rating_by_genre(titles: DataFrame) -> DataFrame:
    rated = titles.filter("average_rating IS NOT NULL")
    return quartiles(genres_of(rated, "average_rating"), ["genre"], "average_rating")


def votes_rating_by_class(titles: DataFrame) -> DataFrame:
    """Votes and ratings per title class, with their correlation."""
    known = titles.filter("num_votes IS NOT NULL AND average_rating IS NOT NULL AND genre_list IS NOT NULL")
    classed = known.withColumn("category", title_class(split_list("genre_list")))
    medians = exact_quantiles(classed, "num_votes", [0.5], ["category"]).select("category", F.col("q0").alias("median_votes"))
    stats = classed.groupBy("category").agg(
        rows().alias("n"), F.avg("average_rating").alias("avg_rating"), F.corr("num_votes", "average_rating").alias("corr")
    )
    return stats.join(medians, "category")


def rating_per_year(titles: DataFrame) -> DataFrame:
    rated = titles.filter("start_year IS NOT NULL AND average_rating IS NOT NULL")
    return rated.groupBy("start_year").agg(F.avg("average_rating").alias("avg_rating"), rows().alias("n"))


def class_per_year(titles: DataFrame, first: int = 1880, last: int = 2030) -> DataFrame:
    """Genre entries per year, one column per class."""
    entries = genres_of(titles.filter(F.col("start_year").between(first, last)), "start_year")
    return pivot_matrix(entries.withColumn("class", genre_class("genre")), "start_year", "class", rows(), CLASSES)


def rating_by_decade_genre(titles: DataFrame, decades: Sequence[int] = (2000, 2010, 2020), n: int = 20) -> DataFrame:
    """Mean rating of the most frequent genres, one column per decade."""
    top = top_categories(genres_of(titles), "genre", n).select("genre")
    rated = titles.filter("start_year IS NOT NULL AND average_rating IS NOT NULL")
    entries = genres_of(rated, decade("start_year").alias("decade"), "average_rating").join(top, "genre", "left_semi")
    return pivot_matrix(entries, "genre", "decade", F.avg("average_rating"), list(decades), fill=None)


def type_trend(titles: DataFrame) -> DataFrame:
    """Mean rating per year of films against series, each title counting once."""
    rated = titles.filter("start_year IS NOT NULL AND average_rating IS NOT NULL").filter(
        F.col("title_type").isin("movie", "tvSeries", "tvMiniSeries")
    )
    broad = F.when(F.col("title_type") == "movie", "Movie").otherwise("TV Series").alias("broad")
    return rated.groupBy("start_year", broad).agg(F.avg("average_rating").alias("avg_rating"), rows().alias("n"))


def runtime_histogram(titles: DataFrame, low: float = 0.0003, high: float = 0.99, bins: int = 20) -> DataFrame:
    movies = titles.filter("title_type = 'movie' AND runtime_minutes > 0").select("runtime_minutes")
    trimmed = trim_quantiles(movies, "runtime_minutes", low, high)
    return histograms(trimmed, ["runtime_minutes"], bins).select("bin", "n")


def runtime_vs_rating(titles: DataFrame, longest: int = 600) -> DataFrame:
    """Correlation and straight-line fit of rating on runtime over all titles."""
    known = titles.filter((F.col("runtime_minutes") > 0) & (F.col("runtime_minutes") < longest) & F.col("average_rating").isNotNull())
    return known.agg(
        rows().alias("n"), F.corr("runtime_minutes", "average_rating").alias("corr"),
        F.regr_slope("average_rating", "runtime_minutes").alias("slope"),
        F.regr_intercept("average_rating", "runtime_minutes").alias("intercept"),
    )


def runtime_by_genre(titles: DataFrame, n: int = 15, longest: int = 600) -> DataFrame:
    known = titles.filter((F.col("runtime_minutes") > 0) & (F.col("runtime_minutes") < longest))
    return quartiles(restrict_to_top(genres_of(known, "runtime_minutes"), "genre", n), ["genre"], "runtime_minutes")


def runtime_per_decade(titles: DataFrame, longest: int = 600) -> DataFrame:
    known = titles.filter((F.col("runtime_minutes") > 0) & (F.col("runtime_minutes") < longest) & F.col("start_year").isNotNull())
    return known.groupBy(decade("start_year").alias("decade")).agg(F.avg("runtime_minutes").alias("avg_runtime"))


# Episodes


def rated_episodes(episodes: DataFrame, titles: DataFrame) -> DataFrame:
    rated = titles.filter("average_rating IS NOT NULL").select(F.col("tconst").alias("episode_key"), "average_rating")
    return episodes.select("episode_key", "series_key", "season_number", "episode_number").join(rated, "episode_key")


def rating_per_season(episodes: DataFrame, titles: DataFrame, last: int = 50) -> DataFrame:
    seasons = rated_episodes(episodes.filter(F.col("season_number").between(1, last)), titles)
    return seasons.groupBy("season_number").agg(F.avg("average_rating").alias("avg_rating"), rows().alias("ep_count"))


def series_episode_ratings(episodes: DataFrame, titles: DataFrame, names: DataFrame) -> DataFrame:
    """Rated episodes of the series with the given names (column ``primary_title``)."""
    series = titles.filter(F.col("title_type").isin("tvSeries", "tvMiniSeries")).join(names, "primary_title", "left_semi")
    chosen = series.select(F.col("tconst").alias("series_key"), F.col("primary_title").alias("series"))
    return rated_episodes(episodes, titles).join(chosen, "series_key").select(
        "series_key", "series", "season_number", "episode_number", "average_rating"
    )


def episode_rating_spread(episodes: DataFrame, titles: DataFrame, last_season: int = 20) -> DataFrame:
    known = rated_episodes(episodes.filter(F.col("season_number") <= last_season), titles)
    return quartiles(known, ["season_number"], "average_rating")


def episode_rating_grid(episodes: DataFrame, titles: DataFrame, last_season: int = 30, last_episode: int = 50) -> DataFrame:
    """Mean rating per season and episode number."""
    inside = episodes.filter((F.col("season_number") <= last_season) & (F.col("episode_number") <= last_episode))
    return rated_episodes(inside, titles).groupBy("season_number", "episode_number").agg(
        F.avg("average_rating").alias("avg_rating"), rows().alias("n")
    )


# People


def _person_keys(by_name: bool) -> list[str]:
    return ["primary_name"] if by_name else ["nconst"]


def _named(df: DataFrame, people: DataFrame) -> DataFrame:
    return df.join(people.select("nconst", "primary_name"), "nconst")


def top_people(performance: DataFrame, people: DataFrame, role: str, n: int = 20, by_name: bool = False) -> DataFrame:
    """People with the most credits in a role."""
    counts = performance.filter(F.col("category") == role).groupBy("nconst").agg(rows().alias("title_count"))
    named = _named(counts, people)
    if by_name:
        named = named.groupBy("primary_name").agg(F.sum("title_count").alias("title_count"))
    return top_n(named, [F.desc("title_count"), *map(F.asc, _person_keys(by_name))], n)


def people_ratings(
    performance: DataFrame, titles: DataFrame, people: DataFrame, role: str, min_n: int, by_name: bool = False
) -> DataFrame:
    """Rated credits and mean rating per person with at least ``min_n`` of them.

    Ratings are added up per person before names are joined.
    """
    rated = titles.filter("average_rating IS NOT NULL").select("tconst", "average_rating")
    credits = performance.filter(F.col("category") == role).select("tconst", "nconst").join(rated, "tconst")
    sums = credits.groupBy("nconst").agg(F.sum("average_rating").alias("_sum"), rows().alias("n"))
    if by_name:
        sums = _named(sums, people).groupBy("primary_name").agg(F.sum("_sum").alias("_sum"), F.sum("n").alias("n"))
        enough = sums.filter(F.col("n") >= min_n)
    else:
        enough = _named(sums.filter(F.col("n") >= min_n), people)
    return enough.withColumn("avg_rating", F.col("_sum") / F.col("n")).drop("_sum")


def top_people_by_rating(
    performance: DataFrame, titles: DataFrame, people: DataFrame, role: str, min_n: int = 10, n: int = 20, by_name: bool = False
) -> DataFrame:
    rated = people_ratings(performance, titles, people, role, min_n, by_name)
    rated = rated.withColumn("avg_rating", F.round("avg_rating", 8))
    return top_n(rated, [F.desc("avg_rating"), *map(F.asc, _person_keys(by_name))], n)


def director_genre_affinity(performance: DataFrame, titles: DataFrame, people: DataFrame, n: int = 20) -> DataFrame:
    """(director, genre, genre_count) of the busiest directors."""
    top = top_people(performance, people, "director", n)
    credits = performance.filter("category = 'director'").select("tconst", "nconst").join(top.select("nconst"), "nconst", "left_semi")
    genres = genres_of(titles, "tconst")
    counts = credits.join(genres, "tconst").groupBy("nconst", "genre").agg(rows().alias("genre_count"))
    return counts.join(top.select("nconst", "primary_name"), "nconst")


def cooccurrence_graph(performance: DataFrame, people: DataFrame, n: int = 500, min_weight: int = 2) -> DataFrame:
    """(a, b, weight): joint credits among the ``n`` busiest actors.

    Credits are counted per title and person first, so a title adds at most n * n / 2 products.
    """
    top = top_people(performance, people, "actor", n).select("nconst")
    credits = performance.filter("category = 'actor'").select("tconst", "nconst").join(top, "nconst", "left_semi")
    counted = credits.groupBy("tconst", "nconst").agg(rows().alias("n"))
    a = counted.select("tconst", F.col("nconst").alias("a"), F.col("n").alias("na"))
    b = counted.select("tconst", F.col("nconst").alias("b"), F.col("n").alias("nb"))
    weights = a.join(b, "tconst").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("weight"))
    return weights.filter(F.col("weight") >= min_weight)


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, weight): each edge from both ends."""
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))
    ))
    return edges.select(ends.alias("_e"), "weight").select("_e.*", "weight")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality) over the nodes that have edges."""
    degrees = both_ways(edges).groupBy("node").agg(F.count_distinct("other").alias("degree"))
    others = degrees.agg(F.greatest(F.count("*") - 1, F.lit(1))).scalar()
    return degrees.withColumn("centrality", F.col("degree") / others)


def communities(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, label): label propagation until nothing changes. In each round a node takes the label with the largest total
    weight among its neighbours, the smallest one among equals. Each round is checkpointed, so plans stay short and
    lost executors cost no earlier round. Such rounds end with fixed labels or with two that alternate, as on an
    isolated pair; then each node takes the smaller of its two and :func:`_settled` goes on. Labels that still
    move after ``rounds`` go on there as well, so any graph gets a result that no node would gain by leaving.
    """
    shared_dir(edges.sparkSession)
    links = both_ways(edges).checkpoint()
    labels = links.select("node").distinct().withColumn("label", F.col("node")).checkpoint()
    older = labels
    for _ in range(rounds):
        votes = links.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        chosen = votes.groupBy("node").agg(F.max_by("label", F.struct(F.col("w"), -F.col("label"))).alias("label")).checkpoint()
        before = labels.withColumnRenamed("label", "old").join(older.withColumnRenamed("label", "older"), "node")
        moved = chosen.join(before, "node").agg(F.count_if(F.col("label") != F.col("old")).alias("now"), F.count_if(F.col("label") != F.col("older")).alias("then")).first()
        if not moved["now"]:
            return chosen
        if not moved["then"]:
            both = chosen.join(labels.withColumnRenamed("label", "old"), "node")
            return _settled(links, both.select("node", F.least("label", "old").alias("label")).checkpoint())
        labels, older = chosen, labels
    return _settled(links, labels)


def _settled(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels that no node would gain by leaving. A node moves to the label with the largest total weight among its neighbours
    if that outweighs its own label there, and if no neighbour gains more (the smaller node among equals). As no two
    neighbours move at once, the weight within labels grows each round, so the rounds end.
    """
    while True:
        votes = links.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.sum("weight").alias("w"))
        votes = votes.join(labels.withColumnRenamed("label", "own"), "node")
        best = votes.groupBy("node").agg(
            F.max_by("label", F.struct(F.col("w"), -F.col("label"))).alias("to"),
            (F.max("w") - F.coalesce(F.max(F.when(F.col("label") == F.col("own"), F.col("w"))), F.lit(0))).alias("gain"),
        )
        moves = best.filter("gain > 0").checkpoint()
        if moves.isEmpty():
            return labels
        rank = F.struct(F.col("gain"), -F.col("node"))
        near = links.join(moves.select(F.col("node").alias("other"), F.struct(F.col("gain"), -F.col("node")).alias("rank")), "other")
        first = moves.join(near.groupBy("node").agg(F.max("rank").alias("rank")), "node", "left").filter(F.col("rank").isNull() | (rank > F.col("rank")))
        labels = labels.join(first.select("node", "to"), "node", "left").select("node", F.coalesce("to", "label").alias("label")).checkpoint()


def role_pair_matrix(
    performance: DataFrame, people: DataFrame, role_a: str, role_b: str, min_n: int = 3, top: int = 15, keep: int = 100
) -> DataFrame:
    """Pairs among the strongest ``keep`` pairs whose members are both in the ``top`` of their side, with names."""
    totals = role_pairs(performance, role_a, role_b, min_n).groupBy("a", "b").agg(F.sum("n").alias("collab_count"))
    known = people.select("nconst", "primary_name")
    for side in ("a", "b"):
        names = known.select(F.col("nconst").alias(side), F.col("primary_name").alias(f"{side}_name"))
        totals = totals.join(names, side)
    strongest = top_n(totals.filter(F.col("collab_count") >= min_n), [F.desc("collab_count"), F.asc("a"), F.asc("b")], keep)
    matrix = strongest
    for side in ("a", "b"):
        best = top_categories(strongest, side, top, F.sum("collab_count")).select(side)
        matrix = matrix.join(best, side, "left_semi")
    return matrix


def role_pair_ratings(performance: DataFrame, titles: DataFrame, role_a: str, role_b: str, min_n: int = 3) -> DataFrame:
    """(a, b, freq, avg_rating) of pairs with enough rated titles."""
    rated = titles.filter("average_rating IS NOT NULL").select("tconst", "average_rating")
    credits = performance.filter(F.col("category").isin(role_a, role_b)).select("tconst", "nconst", "category").join(rated, "tconst")
    joint = role_pairs(credits, role_a, role_b, min_n, keep=["average_rating"])
    total = F.sum(F.col("average_rating") * F.col("n")) / F.sum("n")
    return joint.groupBy("a", "b").agg(F.sum("n").alias("freq"), total.alias("avg_rating")).filter(F.col("freq") >= min_n)


def career_trajectories(
    performance: DataFrame, titles: DataFrame, people: DataFrame, n: int = 6, roles: Sequence[str] = ("director", "actor")
) -> DataFrame:
    """Mean rating per year, over all credits, of the people with most dated credits in the roles."""
    counts = dated_credits(performance, titles, roles).groupBy("nconst").agg(rows().alias("credits"))
    top = top_n(_named(counts, people), [F.desc("credits"), F.asc("nconst")], n).select("nconst", "primary_name")
    rated = titles.filter("start_year IS NOT NULL AND average_rating IS NOT NULL").select("tconst", "start_year", "average_rating")
    credits = performance.select("tconst", "nconst").join(top, "nconst").join(rated, "tconst")
    return credits.groupBy("nconst", "primary_name", "start_year").agg(F.avg("average_rating").alias("avg_rating"))


def career_lengths(performance: DataFrame, titles: DataFrame, roles: Sequence[str] = ("director", "actor")) -> DataFrame:
    """Years from first to last credit, both counted, of people active in two years or more."""
    spans = dated_credits(performance, titles, roles).groupBy("nconst", "category").agg(
        F.min("start_year").alias("first"), F.max("start_year").alias("last")
    )
    return spans.filter("first < last").select("nconst", "category", (F.col("last") - F.col("first") + 1).alias("career_length"))


def time_to_peak(performance: DataFrame, titles: DataFrame, roles: Sequence[str] = ("director", "actor"), min_n: int = 5) -> DataFrame:
    """Debut, year of the best-rated credit (the earliest id among equals) and the years between."""
    rated = titles.filter("average_rating IS NOT NULL").select("tconst", "start_year", "average_rating")
    credits = dated_credits(performance, rated, roles).join(rated.select("tconst", "average_rating"), "tconst")
    keys = ["nconst", "category"]
    peak = arg_max(credits, keys, "start_year", "average_rating", "peak_rating_year", tie="tconst")
    debut = credits.groupBy(*keys).agg(F.min("start_year").alias("debut_year"), rows().alias("n")).filter(F.col("n") >= min_n)
    return debut.join(peak, keys).select(
        *keys, "debut_year", "peak_rating_year", (F.col("peak_rating_year") - F.col("debut_year")).alias("time_to_peak")
    )


def career_survival(performance: DataFrame, titles: DataFrame, roles: Sequence[str] = ("director", "actor"), max_t: int = 60) -> DataFrame:
    spans = dated_credits(performance, titles, roles).groupBy("nconst", "category").agg(
        (F.max("start_year") - F.min("start_year")).alias("length")
    )
    return survival_curve(spans, "category", "length", max_t)


# Documentaries, regions, types, popularity, adult titles


def flag_of(genre: str) -> Column:
    return F.when(has_item("genre_list", genre), genre).otherwise("Other")


def flag_rating_by_type(titles: DataFrame, genre: str = "Documentary", types: Sequence[str] = ("movie", "tvSeries", "short")) -> DataFrame:
    rated = titles.filter(F.col("average_rating").isNotNull() & F.col("title_type").isin(list(types)))
    return rated.groupBy(flag_of(genre).alias("flag"), "title_type").agg(F.avg("average_rating").alias("avg_rating"), rows().alias("cnt"))


def flag_per_year(titles: DataFrame, genre: str = "Documentary") -> DataFrame:
    return titles.filter(has_item("genre_list", genre) & F.col("start_year").isNotNull()).groupBy("start_year").agg(rows().alias("n"))


def co_genres(titles: DataFrame, genre: str = "Documentary", n: int = 15) -> DataFrame:
    """Genres of the titles with a genre, itself included."""
    return top_categories(genres_of(titles.filter(has_item("genre_list", genre))), "genre", n)


def flag_runtime_rating(titles: DataFrame, genre: str = "Documentary", longest: int = 1000) -> DataFrame:
    known = titles.filter((F.col("runtime_minutes") > 0) & (F.col("runtime_minutes") < longest) & F.col("average_rating").isNotNull())
    return known.groupBy(flag_of(genre).alias("flag")).agg(
        rows().alias("n"), F.avg("runtime_minutes").alias("avg_runtime"), F.avg("average_rating").alias("avg_rating"),
        F.corr("runtime_minutes", "average_rating").alias("corr"),
    )


def titles_per_region(titles: DataFrame) -> DataFrame:
    return genres_of(titles, source="region_list", name="region").groupBy("region").agg(rows().alias("title_count"))


def aka_per_region(titles: DataFrame, n: int = 20) -> DataFrame:
    known = genres_of(titles.filter("aka_count IS NOT NULL"), "aka_count", source="region_list", name="region")
    return top_n(known.groupBy("region").agg(F.sum("aka_count").alias("total_aka")), [F.desc("total_aka"), F.asc("region")], n)


def language_region_matrix(akas: DataFrame, n: int = 20) -> DataFrame:
    """(language, region, cnt) among the most frequent of each, from the alternative titles themselves."""
    counts = akas.filter("language IS NOT NULL AND region IS NOT NULL").groupBy("language", "region").agg(rows().alias("cnt"))
    languages = top_categories(counts, "language", n, F.sum("cnt")).select("language")
    regions = top_categories(counts, "region", n, F.sum("cnt")).select("region")
    return counts.join(languages, "language", "left_semi").join(regions, "region", "left_semi")


def region_volume_rating(titles: DataFrame, min_n: int = 10) -> DataFrame:
    rated = genres_of(titles.filter("average_rating IS NOT NULL"), "average_rating", source="region_list", name="region")
    stats = rated.groupBy("region").agg(rows().alias("title_count"), F.avg("average_rating").alias("avg_rating"))
    return stats.filter(F.col("title_count") >= min_n)


def type_counts(titles: DataFrame) -> DataFrame:
    return titles.groupBy("title_type").agg(rows().alias("cnt"))


def type_rating_spread(titles: DataFrame, types: Sequence[str] = PLOTTED_TYPES) -> DataFrame:
    rated = titles.filter(F.col("average_rating").isNotNull() & F.col("title_type").isin(list(types)))
    return quartiles(rated, ["title_type"], "average_rating")


def type_share_per_year(titles: DataFrame, types: Sequence[str] = PLOTTED_TYPES) -> DataFrame:
    dated = titles.filter(F.col("start_year").isNotNull() & F.col("title_type").isin(list(types)))
    return proportion(dated, ["start_year"], ["title_type"])


def voted(titles: DataFrame) -> DataFrame:
    return titles.filter("num_votes > 0 AND average_rating IS NOT NULL")


def popularity_quadrants(titles: DataFrame) -> DataFrame:
    """Each voted title with its quadrant; the split points are the exact medians."""
    known = voted(titles)
    votes = exact_quantiles(known, "num_votes", [0.5]).select(F.col("q0").alias("_mid_votes"))
    rating = exact_quantiles(known, "average_rating", [0.5]).select(F.col("q0").alias("_mid_rating"))
    both = cross_scalar(cross_scalar(known, votes), rating)
    label = quadrant(F.col("num_votes"), F.col("average_rating"), F.col("_mid_votes"), F.col("_mid_rating"))
    return both.select("tconst", "num_votes", "average_rating", label.alias("quadrant"))


def most_voted(titles: DataFrame, n: int = 20) -> DataFrame:
    return top_n(titles.select("tconst", "primary_title", "num_votes"), [F.desc_nulls_last("num_votes"), F.asc("tconst")], n)


def votes_per_year(titles: DataFrame) -> DataFrame:
    known = titles.filter("start_year IS NOT NULL AND num_votes > 0")
    return known.groupBy("start_year").agg(F.avg("num_votes").alias("avg_votes"))


def adult_breakdown(titles: DataFrame) -> DataFrame:
    """Titles, rated titles and mean rating by adult flag."""
    status = F.when(F.col("is_adult"), "Adult").otherwise("Non-Adult").alias("adult_status")
    return titles.groupBy(status).agg(
        rows().alias("cnt"), F.count("average_rating").alias("rated"), F.avg("average_rating").alias("avg_rating")
    )


def adult_genres(titles: DataFrame, n: int = 15) -> DataFrame:
    return top_categories(genres_of(titles.filter("is_adult")), "genre", n)


def adult_per_year(titles: DataFrame) -> DataFrame:
    return titles.filter("is_adult AND start_year IS NOT NULL").groupBy("start_year").agg(rows().alias("adult_count"))


def bayesian_top(titles: DataFrame, n: int = 20) -> DataFrame:
    """Best titles by weighted rating; the prior is the rounded mean rating with the median number of votes."""
    known = voted(titles)
    prior = known.agg(F.round(F.avg("average_rating"), 2).alias("_rating"))
    votes = exact_quantiles(known, "num_votes", [0.5]).select(F.col("q0").alias("_votes"))
    both = cross_scalar(cross_scalar(known, prior), votes)
    score = weighted_rating(F.col("average_rating"), F.col("num_votes"), F.col("_rating"), F.col("_votes"))
    scored = both.select(
        "tconst", "primary_title", "start_year", F.col("average_rating").alias("rating"), F.col("num_votes").alias("votes"),
        F.round(score, 2).alias("weighted_rating"),
    )
    return top_n(scored, [F.desc("weighted_rating"), F.desc("votes"), F.asc("tconst")], n)


def segment_summary(titles: DataFrame) -> DataFrame:
    """Rated titles per vote segment ('unrated' without votes): count, mean rating and votes, and the overall
    correlation of votes and ratings."""
    rated = titles.filter("average_rating IS NOT NULL")
    segment = F.when(F.col("num_votes") > 0, popularity_segment("num_votes")).otherwise("unrated").alias("segment")
    corr = voted(titles).agg(F.corr("num_votes", "average_rating").alias("corr"))
    stats = rated.groupBy(segment).agg(
        rows().alias("cnt"), F.avg("average_rating").alias("avg_rating"), F.avg("num_votes").alias("avg_votes")
    )
    return cross_scalar(stats, corr)
