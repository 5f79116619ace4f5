"""Joins."""

from pyspark.sql import functions as F

from marquee.operators import joins
from marquee.plans import marts
from marquee.suite import marts as mart_queries
from marquee.suite.core import query



@query("d01_title_assembly", """
SELECT t.tconst, r.average_rating, e.season_number,
  (SELECT string_agg(g, ', ' ORDER BY g) FROM (SELECT unnest(string_split(t.genres, ',')) AS g)) AS genre_list
FROM title_basics t LEFT JOIN title_rating r ON r.tconst = t.tconst AND r.snapshot_date = DATE '2024-03-01'
LEFT JOIN title_episode e ON e.tconst = t.tconst WHERE t.is_current""")
def d01(s):
    details = marts.title_details(*mart_queries.title_inputs(s))
    return details.select("tconst", "average_rating", "season_number", "genre_list")


@query("d02_episodes_with_series", """
SELECT e.tconst, e.parent_tconst, b.primary_title AS series_title, b.start_year AS series_start_year, b.title_type AS series_type
FROM title_episode e LEFT JOIN title_basics b
  ON b.tconst = e.parent_tconst AND b.is_current AND b.title_type IN ('tvMiniSeries', 'tvSeries')""")
def d02(s):
    joined = joins.episodes_with_series(s.title_episode, s.title_basics)
    return joined.select("tconst", "parent_tconst", "series_title", "series_start_year", "series_type")


@query("d03_principal_by_character", f"""
WITH {mart_queries.CHARS_SQL}
SELECT p.tconst, p.ordering, p.nconst, c.character_name FROM title_principal p
LEFT JOIN chars c ON c.tconst = p.tconst AND c.ordering = p.ordering""")
def d03(s):
    principal = s.title_principal.select("tconst", "ordering", "nconst")
    return joins.expand_left(principal, mart_queries.characters(s), ["tconst", "ordering"])


@query("d04_principal_with_characters", f"""
WITH {mart_queries.CHARS_SQL},
names AS (SELECT tconst, ordering, array_to_string(list_sort(list(character_name)), ', ') AS characters FROM chars GROUP BY ALL)
SELECT p.tconst, p.ordering, p.nconst, n.characters FROM title_principal p LEFT JOIN names n USING (tconst, ordering)""")
def d04(s):
    named = joins.ordered_concat(
        mart_queries.characters(s), ["tconst", "ordering"], "character_name", ["character_name"], "characters"
    )
    return s.title_principal.select("tconst", "ordering", "nconst").join(named, ["tconst", "ordering"], "left")


@query("d05_pairs", """
WITH a AS (SELECT DISTINCT tconst, nconst FROM fact_performance WHERE category IN ('actor', 'actress'))
SELECT a.tconst, a.nconst AS nconst_a, b.nconst AS nconst_b FROM a, a b WHERE a.tconst = b.tconst AND a.nconst < b.nconst""")
def d05(s):
    acting = s.fact_performance.filter(F.col("category").isin(*marts.ACTING))
    return joins.pairs(acting.select("tconst", "nconst").distinct(), "tconst", "nconst")


MOST_CREDITED = "(SELECT nconst FROM fact_performance GROUP BY nconst ORDER BY count(*) DESC, nconst LIMIT 1)"


def most_credited(s):
    counts = s.fact_performance.groupBy("nconst").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "nconst").limit(1).select("nconst").scalar()


@query("d06_collaborators", f"""
SELECT o.nconst, count(*) AS collab_count FROM fact_performance m JOIN fact_performance o ON o.tconst = m.tconst
WHERE m.nconst = {MOST_CREDITED} AND o.nconst <> m.nconst GROUP BY o.nconst ORDER BY 2 DESC, 1 LIMIT 20""")
def d06(s):
    return joins.collaborators(s.fact_performance, most_credited(s), 20)


@query("d07_restrict", """
SELECT tconst, nconst, category FROM fact_performance WHERE tconst IN (SELECT tconst FROM dim_title WHERE title_type = 'movie')""")
def d07(s):
    movies = s.dim_title.filter("title_type = 'movie'")
    return joins.restrict(s.fact_performance.select("tconst", "nconst", "category"), movies, "tconst")


# An older load of the same people: some names and years differ, some people are missing.
OLD_PEOPLE = """(SELECT nconst, CASE WHEN nconst % 7 = 1 THEN concat(primary_name, ' (old)') ELSE primary_name END AS primary_name,
  CASE WHEN nconst % 9 = 2 THEN NULL ELSE birth_year END AS birth_year FROM name_basics WHERE nconst % 10 <> 5)"""


def old_people(s):
    renamed = F.expr("CASE WHEN nconst % 7 = 1 THEN concat(primary_name, ' (old)') ELSE primary_name END")
    return s.name_basics.filter("nconst % 10 <> 5").select(
        "nconst", renamed.alias("primary_name"), F.expr("CASE WHEN nconst % 9 = 2 THEN NULL ELSE birth_year END").alias("birth_year")
    )


@query("d08_new_versions", f"""
SELECT nconst, primary_name, birth_year FROM name_basics EXCEPT SELECT nconst, primary_name, birth_year FROM {OLD_PEOPLE}""")
def d08(s):
    columns = ["nconst", "primary_name", "birth_year"]
    return joins.new_versions(s.name_basics.select(*columns), old_people(s), columns)


@query("d09_orphans", """
SELECT e.tconst, e.parent_tconst FROM title_episode e LEFT JOIN title_basics b ON b.tconst = e.parent_tconst AND b.is_current
WHERE b.tconst IS NULL""")
def d09(s):
    parents = marts.current(s.title_basics)
    return joins.orphans(s.title_episode.select("tconst", "parent_tconst"), parents, "parent_tconst", "tconst")


@query("d10_cross_scalar", """
SELECT tconst, average_rating, a.top, a.low FROM dim_title, (SELECT max(average_rating) AS top, min(average_rating) AS low FROM dim_title) a
WHERE average_rating IS NOT NULL""")
def d10(s):
    rated = s.dim_title.filter("average_rating IS NOT NULL").select("tconst", "average_rating")
    return joins.cross_scalar(rated, rated.agg(F.max("average_rating").alias("top"), F.min("average_rating").alias("low")))


@query("d11_latest_snapshot", """
SELECT tconst, average_rating, num_votes FROM title_rating WHERE snapshot_date = (SELECT max(snapshot_date) FROM title_rating)""")
def d11(s):
    return joins.latest_snapshot(s.title_rating).select("tconst", "average_rating", "num_votes")


@query("d12_recompute_list", """
SELECT f.tconst, string_agg(p.primary_name, ', ' ORDER BY f.ordering, f.nconst) AS calc_directors
FROM fact_performance f JOIN dim_person p ON p.nconst = f.nconst WHERE f.category = 'director' GROUP BY f.tconst""")
def d12(s):
    return joins.recompute_list(s.fact_performance, s.dim_person, "director", "calc_directors")


@query("d13_person_category_year_join", """
WITH c AS (SELECT f.tconst, f.nconst, f.category, d.start_year AS title_year FROM fact_performance f JOIN dim_title d USING (tconst)
  WHERE d.start_year IS NOT NULL AND f.category IN ('director', 'writer')),
st AS (SELECT nconst, category, title_year, count(*) AS credits FROM c GROUP BY ALL)
SELECT c.tconst, c.nconst, c.category, c.title_year, st.credits FROM c JOIN st USING (nconst, category, title_year)""")
def d13(s):
    from marquee.operators.features import dated_credits

    crew = dated_credits(s.fact_performance, s.dim_title, ["director", "writer"]).withColumnRenamed("start_year", "title_year")
    stats = crew.groupBy("nconst", "category", F.col("title_year").alias("year")).agg(F.count("*").alias("credits"))
    return joins.crew_stats_join(crew, stats, {"nconst": "nconst", "category": "category", "title_year": "year"})


@query("d14_genre_year_join", """
WITH g AS (SELECT tconst, start_year, average_rating, unnest(string_split(genre_list, ', ')) AS genre FROM dim_title),
st AS (SELECT genre, start_year, round(avg(average_rating), 8) AS avg_rating FROM g
       WHERE start_year IS NOT NULL AND average_rating IS NOT NULL GROUP BY ALL)
SELECT g.tconst, g.genre, st.avg_rating FROM g LEFT JOIN st ON st.genre = g.genre AND st.start_year = g.start_year""")
def d14(s):
    from marquee.operators.features import exploded_genres

    genres = exploded_genres(s.dim_title)
    rated = genres.filter("start_year IS NOT NULL AND average_rating IS NOT NULL")
    stats = rated.groupBy("genre", "start_year").agg(F.round(F.avg("average_rating"), 8).alias("avg_rating"))
    return joins.genre_year_join(genres, stats, ["avg_rating"])


@query("d15_role_pairs", """
SELECT w.tconst, w.nconst AS a, d.nconst AS b, count(*) AS n FROM fact_performance w JOIN fact_performance d ON d.tconst = w.tconst
WHERE w.category = 'writer' AND d.category = 'director' GROUP BY ALL""")
def d15(s):
    return joins.role_pairs(s.fact_performance, "writer", "director")


@query("d16_credits_with_names", """
SELECT f.tconst, f.ordering, f.nconst, f.category, p.primary_name FROM fact_performance f LEFT JOIN dim_person p ON p.nconst = f.nconst""")
def d16(s):
    credits = s.fact_performance.select("tconst", "ordering", "nconst", "category")
    return joins.lookup(credits, s.dim_person, "nconst", ["primary_name"])
