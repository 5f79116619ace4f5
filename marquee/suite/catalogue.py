"""Catalogue queries. Looked-up titles and people are found from the data: the busiest, the most voted."""

from pyspark.sql import functions as F

from marquee.operators.normalize import normalize_json_list
from marquee.plans import catalogue as cat
from marquee.plans import marts
from marquee.suite.core import query
from marquee.suite.joins import MOST_CREDITED, most_credited
from marquee.suite.marts import CHARS_SQL, DIM_PERSON_SQL, person_inputs

SUM = "tconst, primary_title, title_type, average_rating, start_year, num_votes, genre_list"

MOST_VOTED = "(SELECT tconst FROM dim_title ORDER BY num_votes DESC NULLS LAST, tconst LIMIT 1)"
LONGEST = "(SELECT tconst FROM fact_performance GROUP BY tconst ORDER BY count(*) DESC, tconst LIMIT 1)"
BIGGEST_SERIES = """(SELECT series_key FROM fact_episode JOIN dim_title ON tconst = series_key
  WHERE title_type IN ('tvSeries', 'tvMiniSeries', 'tvMovie', 'tvSpecial') GROUP BY series_key ORDER BY count(*) DESC, series_key LIMIT 1)"""


def most_voted(s):
    return s.dim_title.orderBy(F.desc_nulls_last("num_votes"), "tconst").limit(1).select("tconst").scalar()


def longest(s):
    """The title with the most credits."""
    counts = s.fact_performance.groupBy("tconst").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "tconst").limit(1).select("tconst").scalar()


def biggest_series(s):
    episodic = s.dim_title.filter(F.col("title_type").isin(*cat.EPISODIC_TYPES)).select(F.col("tconst").alias("series_key"))
    counts = s.fact_episode.join(episodic, "series_key", "left_semi").groupBy("series_key").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "series_key").limit(1).select("series_key").scalar()


def principal_mart(s):
    characters = normalize_json_list(s.title_principal, ["tconst", "ordering"], "characters", "character_name")
    return marts.fact_title_principal(s.title_principal, characters)


PRINCIPALS_SQL = f"""{CHARS_SQL},
ftp AS (SELECT p.tconst AS title_key, p.nconst AS name_key, (SELECT string_agg(c.character_name, ', ' ORDER BY c.character_name) FROM chars c
  WHERE c.tconst = p.tconst AND c.ordering = p.ordering) AS character_name, p.ordering, p.category, p.job FROM title_principal p
  WHERE p.tconst = {LONGEST}),
billed AS (SELECT f.name_key, d.primary_name, f.character_name, f.ordering, f.category, f.job FROM ftp f LEFT JOIN dim_person d ON d.nconst = f.name_key)"""


@query("m01_title", f"SELECT {SUM}, array_to_string(string_split(genre_list, ', '), '|') AS genres FROM dim_title WHERE tconst = {MOST_VOTED}")
def m01(s):
    return cat.title(s.dim_title, most_voted(s)).select(*cat.SUMMARY, F.array_join("genres", "|").alias("genres"))


@query("m02_cast", f"""
WITH {PRINCIPALS_SQL} SELECT * FROM billed WHERE category IN ('actor', 'actress', 'self')
ORDER BY ordering, name_key, category, character_name NULLS LAST, job NULLS LAST LIMIT 20""")
def m02(s):
    return cat.cast(principal_mart(s), s.dim_person, longest(s), 20)


@query("m03_crew", f"""
WITH {PRINCIPALS_SQL} SELECT name_key, primary_name, ordering, category, job FROM billed WHERE category NOT IN ('actor', 'actress', 'self')""")
def m03(s):
    return cat.crew(principal_mart(s), s.dim_person, longest(s))


@query("m04_similar", f"""
WITH src AS (SELECT title_type, string_split(genre_list, ', ')[1:3] AS gs FROM dim_title WHERE tconst = {MOST_VOTED}),
c AS (SELECT d.* FROM dim_title d, src WHERE d.tconst <> {MOST_VOTED} AND NOT list_contains(string_split(d.genre_list, ', '), 'Adult')
  AND list_has_any(string_split(d.genre_list, ', '), src.gs) AND average_rating IS NOT NULL AND num_votes >= 1000
  AND list_contains(CASE WHEN src.title_type IN ('movie', 'short', 'video') THEN ['movie', 'short', 'video']
    WHEN src.title_type IN ('tvSeries', 'tvMiniSeries', 'tvSpecial') THEN ['tvSeries', 'tvMiniSeries', 'tvSpecial']
    ELSE ['movie', 'tvSeries', 'tvMiniSeries'] END, d.title_type))
SELECT {SUM} FROM (FROM c QUALIFY row_number() OVER (PARTITION BY primary_title ORDER BY num_votes DESC, tconst) = 1)
ORDER BY average_rating DESC, num_votes DESC, tconst LIMIT 12""")
def m04(s):
    return cat.similar(s.dim_title, most_voted(s), 12)


@query("m05_episodes", f"""
SELECT {SUM}, e.season_number, e.episode_number FROM fact_episode e LEFT JOIN (SELECT {SUM} FROM dim_title) d ON d.tconst = e.episode_key
WHERE e.series_key = {BIGGEST_SERIES} ORDER BY e.season_number, e.episode_number, tconst LIMIT 100""")
def m05(s):
    return cat.episodes(s.fact_episode, s.dim_title, biggest_series(s), 100)


FILMS = f"""SELECT f.tconst, f.category, f.character_name, primary_title, title_type, average_rating, start_year, num_votes, genre_list
FROM fact_performance f LEFT JOIN dim_title d ON d.tconst = f.tconst WHERE f.nconst = {MOST_CREDITED}
ORDER BY start_year DESC NULLS LAST, f.tconst, f.category, f.character_name NULLS LAST LIMIT 50"""


@query("m06_filmography", FILMS)
def m06(s):
    return cat.filmography(s.fact_performance, s.dim_title, most_credited(s), 50)


def people(s):
    return marts.dim_person(*person_inputs(s))


# People whose known-for list has entries, the one with the longest list of names.
LISTED_PERSON = "(SELECT nconst FROM people_mart WHERE known_for_titles IS NOT NULL ORDER BY length(known_for_titles) DESC, nconst LIMIT 1)"


def listed_person(s):
    mart = people(s).filter("known_for_titles IS NOT NULL")
    return mart.orderBy(F.desc(F.length("known_for_titles")), "nconst").limit(1).select("nconst").scalar()


@query("m07_known_for", f"""
WITH people_mart AS ({DIM_PERSON_SQL}), ids AS (SELECT CAST(unnest(l) AS BIGINT) AS tconst, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT string_split(known_for_ids, ',') AS l FROM people_mart WHERE nconst = {LISTED_PERSON}))
SELECT CAST(pos AS INTEGER) AS pos, {SUM} FROM ids JOIN dim_title USING (tconst)""")
def m07(s):
    return cat.known_for(people(s), s.dim_title, listed_person(s), 10)


@query("m07_known_for_by_name", f"""
WITH people_mart AS ({DIM_PERSON_SQL}), names AS (SELECT trim(unnest(l)) AS name, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT string_split(known_for_titles, ',') AS l FROM people_mart WHERE nconst = {LISTED_PERSON})),
b AS (SELECT pos, d.* FROM names JOIN dim_title d ON contains(lower(d.primary_title), lower(name))
  QUALIFY row_number() OVER (PARTITION BY pos ORDER BY num_votes DESC NULLS LAST, tconst) = 1)
SELECT CAST(min(pos) AS INTEGER) AS pos, {SUM} FROM b GROUP BY ALL""")
def m07_by_name(s):
    """A person mart without the id column: names decide."""
    mart = people(s)
    return cat.known_for(mart.drop("known_for_ids"), s.dim_title, listed_person(s), 10)


COLLABORATORS = f"""SELECT o.nconst, p.primary_name, count(*) AS collab_count FROM fact_performance m JOIN fact_performance o ON o.tconst = m.tconst
JOIN dim_person p ON p.nconst = o.nconst WHERE m.nconst = {MOST_CREDITED} AND o.nconst <> m.nconst GROUP BY ALL ORDER BY 3 DESC, 1 LIMIT 20"""


@query("m08_collaborators", COLLABORATORS)
def m08(s):
    return cat.collaborators(s.fact_performance, s.dim_person, most_credited(s), 20)


@query("m09_person", f"""
WITH people_mart AS ({DIM_PERSON_SQL}), films AS ({FILMS}), coll AS ({COLLABORATORS.replace('dim_person', 'people_mart')}),
ids AS (SELECT CAST(unnest(l) AS BIGINT) AS tconst, generate_subscripts(l, 1) AS pos
  FROM (SELECT string_split(known_for_ids, ',') AS l FROM people_mart WHERE nconst = {MOST_CREDITED} AND known_for_titles IS NOT NULL))
SELECT p.nconst, p.primary_name, p.birth_year, replace(p.profession_list, ', ', '|') AS professions,
  coalesce((SELECT string_agg(tconst, ',' ORDER BY pos) FROM ids JOIN dim_title USING (tconst)), '') AS known_for,
  (SELECT string_agg(tconst || ' ' || category, ',' ORDER BY coalesce(start_year, 0) DESC, tconst, category, character_name NULLS FIRST) FROM films) AS filmography,
  (SELECT string_agg(nconst || ' ' || collab_count, ',' ORDER BY collab_count DESC, nconst) FROM coll) AS collaborators
FROM people_mart p WHERE p.nconst = {MOST_CREDITED}""")
def m09(s):
    row = cat.person(people(s), s.fact_performance, s.dim_title, most_credited(s))
    text = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return row.select(
        "nconst", "primary_name", "birth_year", F.array_join("professions", "|").alias("professions"),
        text("known_for", lambda x: x["tconst"].cast("string")),
        text("filmography", lambda x: F.concat_ws(" ", x["tconst"].cast("string"), x["category"])),
        text("collaborators", lambda x: F.concat_ws(" ", x["nconst"].cast("string"), (-x["rank"]).cast("string"))),
    )


def page_sql(where, order, first, offset):
    return f"""WITH m AS (SELECT {SUM} FROM dim_title WHERE {where}), n AS (SELECT count(*) AS total FROM m)
SELECT m.*, total, CASE WHEN {offset + first} < total THEN CAST({offset + first} AS BIGINT) END AS next_offset FROM m, n
ORDER BY {order}, tconst LIMIT {first} OFFSET {offset}"""


@query("m10_search", page_sql("contains(lower(primary_title), 'story 1')", "num_votes DESC NULLS LAST", 50, 50))
def m10(s):
    return cat.search(s.dim_title, "STORY 1", 50, 50)


@query("m10_search_wildcards", page_sql("contains(lower(primary_title), '100% story_1')", "num_votes DESC NULLS LAST", 50, 0))
def m10_wildcards(s):
    """``%`` and ``_`` of the text mean themselves."""
    return cat.search(s.dim_title, "100% story_1")


@query("m11_browse", page_sql(
    "(contains(genre_list, 'Drama') OR contains(genre_list, 'Crime')) AND start_year BETWEEN 2010 AND 2019 AND title_type = 'movie' AND average_rating >= 6",
    "start_year DESC", 100, 20))
def m11(s):
    return cat.browse(s.dim_title, ["Drama", "Crime"], 2010, "movie", 6.0, "year", 100, 20)


LISTED_SQL = f"SELECT {SUM} FROM dim_title WHERE average_rating IS NOT NULL AND title_type IN ('movie', 'tvSeries', 'tvMiniSeries') AND num_votes > "
TRENDING_SQL = f"""SELECT * FROM ({LISTED_SQL}100) QUALIFY row_number() OVER (PARTITION BY primary_title ORDER BY num_votes DESC, tconst) = 1
ORDER BY num_votes DESC, tconst LIMIT """
TOP_SQL = f"""SELECT * FROM ({LISTED_SQL}1000) QUALIFY row_number() OVER (PARTITION BY primary_title ORDER BY average_rating DESC, num_votes DESC, tconst) = 1
ORDER BY average_rating DESC, num_votes DESC, tconst LIMIT """


@query("m12_trending", TRENDING_SQL + "20")
def m12(s):
    return cat.trending(s.dim_title, 20)


@query("m13_top_rated", TOP_SQL + "20")
def m13(s):
    return cat.top_rated(s.dim_title, 20)


@query("m14_homepage", f"""SELECT *, 'trending' AS section FROM ({TRENDING_SQL}20) UNION ALL SELECT *, 'top_rated' FROM ({TOP_SQL}20)
UNION ALL SELECT *, 'featured' FROM ({TRENDING_SQL}10)""")
def m14(s):
    return cat.homepage(s.dim_title)


@query("m15_rating_history", f"""
SELECT snapshot_date, average_rating, num_votes FROM title_rating WHERE tconst = {MOST_VOTED} AND average_rating IS NOT NULL
AND snapshot_date > (SELECT max(snapshot_date) FROM title_rating) - 45""")
def m15(s):
    return cat.rating_history(marts.fact_title_rating(s.title_rating), most_voted(s), days=45)


@query("m16_search_person", """
SELECT * FROM dim_person WHERE contains(lower(primary_name), 'namesake') ORDER BY primary_name, nconst LIMIT 20""")
def m16(s):
    return cat.search_person(s.dim_person, "nameSAKE", 20)


@query("m17_list_titles", page_sql(
    "contains(lower(primary_title), 'story') AND title_type = 'tvSeries' AND list_contains(string_split(genre_list, ', '), 'Comedy') AND start_year BETWEEN 2005 AND 2016",
    "primary_title", 20, 40))
def m17(s):
    return cat.list_titles(s.dim_title, "story", "tvSeries", "Comedy", 2005, 2016, "title", number=3, per_page=20)


@query("m18_title_detail", f"""
WITH {PRINCIPALS_SQL},
w AS (SELECT string_agg(DISTINCT primary_name, ', ' ORDER BY primary_name) FILTER (WHERE category = 'director') AS directors,
  string_agg(DISTINCT primary_name, ', ' ORDER BY primary_name) FILTER (WHERE category = 'writer') AS writers, count(*) AS principals FROM billed)
SELECT {SUM}, runtime_minutes, coalesce(directors, '') AS directors, coalesce(writers, '') AS writers, principals FROM dim_title, w WHERE tconst = {LONGEST}""")
def m18(s):
    return cat.title_detail(s.dim_title, principal_mart(s), s.dim_person, longest(s))


@query("m19_principals", f"""
WITH {PRINCIPALS_SQL} SELECT name_key, primary_name, ordering, category, job,
  CASE WHEN category IN ('actor', 'actress', 'self') THEN 'cast' ELSE 'crew' END AS part FROM billed""")
def m19(s):
    return cat.principals(principal_mart(s), s.dim_person, longest(s))


@query("m20_search_all", """
SELECT 'title' AS kind, tconst AS id, primary_title AS name FROM (FROM dim_title WHERE contains(primary_title, '4') ORDER BY num_votes DESC NULLS LAST, tconst LIMIT 20)
UNION ALL SELECT 'person', nconst, primary_name FROM (FROM dim_person WHERE contains(primary_name, '4') ORDER BY primary_name, nconst LIMIT 20)""")
def m20(s):
    return cat.search_all(s.dim_title, s.dim_person, "4")
