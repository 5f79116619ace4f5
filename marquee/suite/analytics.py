"""Exploratory analytics over whole tables."""

from pyspark.sql import functions as F

from marquee.plans import analytics as an
from marquee.suite.core import query
from marquee.suite.scalars import FICTION, NONFICTION

GENRES = "g AS (SELECT * EXCLUDE genre_list, unnest(string_split(genre_list, ', ')) AS genre FROM dim_title)"
REGIONS = "g AS (SELECT * EXCLUDE region_list, unnest(string_split(region_list, ', ')) AS region FROM dim_title)"


def rounded(df, *columns, digits=8):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def box(column):
    """Check columns of a quartile table."""
    return (f"min({column}) AS low, round(quantile_cont({column}, 0.25), 8) AS q1, round(quantile_cont({column}, 0.5), 8) AS q2,"
            f" round(quantile_cont({column}, 0.75), 8) AS q3, max({column}) AS high, count(*) AS n")


def boxed(df):
    return rounded(df, "q1", "q2", "q3")


AVG = "round(avg(average_rating), 8) AS avg_rating"


@query("n01_titles_per_genre", f"WITH {GENRES} SELECT genre, count(*) AS title_cnt FROM g GROUP BY genre")
def n01(s):
    return an.titles_per_genre(s.dim_title)


@query("n02_rating_by_genre", f"WITH {GENRES} SELECT genre, {box('average_rating')} FROM g WHERE average_rating IS NOT NULL GROUP BY genre")
def n02(s):
    return boxed(an.rating_by_genre(s.dim_title))


@query("n03_votes_rating_by_class", f"""
SELECT CASE WHEN list_has_any(string_split(genre_list, ', '), [{NONFICTION}]) THEN 'Non-fiction'
  WHEN list_has_any(string_split(genre_list, ', '), [{FICTION}]) THEN 'Fiction' ELSE 'Other' END AS category, count(*) AS n, {AVG},
  round(corr(num_votes, average_rating), 6) AS corr, median(num_votes) AS median_votes
FROM dim_title WHERE num_votes IS NOT NULL AND average_rating IS NOT NULL AND genre_list IS NOT NULL GROUP BY 1""")
def n03(s):
    return rounded(rounded(an.votes_rating_by_class(s.dim_title), "avg_rating"), "corr", digits=6)


@query("n04_rating_per_year", f"""
SELECT start_year, {AVG}, count(*) AS n FROM dim_title WHERE start_year IS NOT NULL AND average_rating IS NOT NULL GROUP BY start_year""")
def n04(s):
    return rounded(an.rating_per_year(s.dim_title), "avg_rating")


@query("n05_class_per_year", f"""
WITH {GENRES}, c AS (SELECT start_year, CASE WHEN genre IN ({FICTION}) THEN 'f' WHEN genre IN ({NONFICTION}) THEN 'n' ELSE 'o' END AS k FROM g WHERE start_year BETWEEN 1880 AND 2030)
SELECT start_year, count(*) FILTER (WHERE k = 'f') AS "Fiction", count(*) FILTER (WHERE k = 'n') AS "Non-fiction", count(*) FILTER (WHERE k = 'o') AS "Other"
FROM c GROUP BY start_year""")
def n05(s):
    return an.class_per_year(s.dim_title)


@query("n06_rating_by_decade_genre", f"""
WITH {GENRES}, top AS (SELECT genre FROM g GROUP BY genre ORDER BY count(*) DESC, genre LIMIT 20)
SELECT genre, round(avg(average_rating) FILTER (WHERE start_year // 10 = 200), 8) AS "2000", round(avg(average_rating) FILTER (WHERE start_year // 10 = 201), 8) AS "2010",
  round(avg(average_rating) FILTER (WHERE start_year // 10 = 202), 8) AS "2020" FROM g WHERE genre IN (FROM top) AND start_year IS NOT NULL AND average_rating IS NOT NULL GROUP BY genre""")
def n06(s):
    return rounded(an.rating_by_decade_genre(s.dim_title), "2000", "2010", "2020")


@query("n07_type_trend", f"""
SELECT start_year, if(title_type = 'movie', 'Movie', 'TV Series') AS broad, {AVG}, count(*) AS n FROM dim_title
WHERE start_year IS NOT NULL AND average_rating IS NOT NULL AND title_type IN ('movie', 'tvSeries', 'tvMiniSeries') GROUP BY 1, 2""")
def n07(s):
    return rounded(an.type_trend(s.dim_title), "avg_rating")


@query("n08_runtime_histogram", """
WITH m AS (SELECT runtime_minutes AS v FROM dim_title WHERE title_type = 'movie' AND runtime_minutes > 0),
q AS (SELECT quantile_cont(v, 0.0003) AS a, quantile_cont(v, 0.99) AS b FROM m), t AS (SELECT v FROM m, q WHERE v BETWEEN a AND b),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM t)
SELECT CAST(b.bin AS INTEGER) AS bin, count(t.v) AS n FROM range(1, 21) b(bin), e LEFT JOIN t ON least(CAST(floor((t.v - e.lo) * 20.0 / (e.hi - e.lo)) AS INTEGER) + 1, 20) = b.bin GROUP BY 1""")
def n08(s):
    return an.runtime_histogram(s.dim_title)


@query("n09_runtime_vs_rating", """
SELECT count(*) AS n, round(corr(runtime_minutes, average_rating), 6) AS corr, round(regr_slope(average_rating, runtime_minutes), 8) AS slope,
  round(regr_intercept(average_rating, runtime_minutes), 6) AS intercept FROM dim_title
WHERE runtime_minutes BETWEEN 1 AND 599 AND average_rating IS NOT NULL""")
def n09(s):
    return rounded(rounded(an.runtime_vs_rating(s.dim_title), "slope"), "corr", "intercept", digits=6)


@query("n10_runtime_by_genre", f"""
WITH {GENRES}, k AS (SELECT * FROM g WHERE runtime_minutes BETWEEN 1 AND 599), top AS (SELECT genre FROM k GROUP BY genre ORDER BY count(*) DESC, genre LIMIT 15)
SELECT genre, {box('runtime_minutes')} FROM k WHERE genre IN (FROM top) GROUP BY genre""")
def n10(s):
    return boxed(an.runtime_by_genre(s.dim_title))


@query("n11_runtime_per_decade", """
SELECT CAST(start_year // 10 * 10 AS INTEGER) AS decade, round(avg(runtime_minutes), 8) AS avg_runtime FROM dim_title
WHERE start_year IS NOT NULL AND runtime_minutes BETWEEN 1 AND 599 GROUP BY 1""")
def n11(s):
    return rounded(an.runtime_per_decade(s.dim_title), "avg_runtime")


EPISODES = """e AS (SELECT f.*, d.average_rating FROM fact_episode f JOIN dim_title d ON d.tconst = f.episode_key WHERE d.average_rating IS NOT NULL)"""


@query("n12_rating_per_season", f"WITH {EPISODES} SELECT season_number, {AVG}, count(*) AS ep_count FROM e WHERE season_number BETWEEN 1 AND 50 GROUP BY 1")
def n12(s):
    return rounded(an.rating_per_season(s.fact_episode, s.dim_title), "avg_rating")


SERIES_NAMES = """(SELECT primary_title FROM dim_title WHERE title_type IN ('tvSeries', 'tvMiniSeries') GROUP BY primary_title
  ORDER BY max(num_votes) DESC NULLS LAST, primary_title LIMIT 30)"""


@query("n13_series_episode_ratings", f"""
WITH {EPISODES} SELECT e.series_key, d.primary_title AS series, e.season_number, e.episode_number, e.average_rating FROM e
JOIN dim_title d ON d.tconst = e.series_key WHERE d.title_type IN ('tvSeries', 'tvMiniSeries') AND d.primary_title IN {SERIES_NAMES}""")
def n13(s):
    """The names of the thirty most voted series."""
    series = s.dim_title.filter("title_type IN ('tvSeries', 'tvMiniSeries')").groupBy("primary_title").agg(F.max("num_votes").alias("v"))
    names = series.orderBy(F.desc_nulls_last("v"), "primary_title").limit(30).select("primary_title")
    return an.series_episode_ratings(s.fact_episode, s.dim_title, names)


@query("n14_episode_rating_spread", f"WITH {EPISODES} SELECT season_number, {box('average_rating')} FROM e WHERE season_number <= 20 GROUP BY 1")
def n14(s):
    return boxed(an.episode_rating_spread(s.fact_episode, s.dim_title))


@query("n14_episode_rating_grid", f"""
WITH {EPISODES} SELECT season_number, episode_number, {AVG}, count(*) AS n FROM e WHERE season_number <= 30 AND episode_number <= 50 GROUP BY 1, 2""")
def n14_grid(s):
    return rounded(an.episode_rating_grid(s.fact_episode, s.dim_title), "avg_rating")


def top_sql(role, by_name=False):
    keys = "primary_name" if by_name else "nconst, primary_name"
    return f"""SELECT {keys}, count(*) AS title_count FROM fact_performance JOIN dim_person USING (nconst) WHERE category = '{role}'
GROUP BY ALL ORDER BY title_count DESC, {keys} LIMIT 20"""


@query("n15_top_directors", top_sql("director"))
def n15(s):
    return an.top_people(s.fact_performance, s.dim_person, "director")


@query("n15_top_directors_by_name", top_sql("director", by_name=True))
def n15_by_name(s):
    return an.top_people(s.fact_performance, s.dim_person, "director", by_name=True)


def rating_sql(role, min_n, limit=True, by_name=False):
    keys = "primary_name" if by_name else "nconst, primary_name"
    return f"""SELECT {keys}, count(*) AS n, {AVG} FROM fact_performance JOIN dim_title USING (tconst) JOIN dim_person USING (nconst)
WHERE category = '{role}' AND average_rating IS NOT NULL GROUP BY ALL HAVING count(*) >= {min_n}""" + (
        f" ORDER BY avg_rating DESC, {keys} LIMIT 20" if limit else "")


@query("n16_directors_by_rating", rating_sql("director", 10))
def n16(s):
    return an.top_people_by_rating(s.fact_performance, s.dim_title, s.dim_person, "director", 10)


@query("n16_directors_by_rating_by_name", rating_sql("director", 10, by_name=True))
def n16_by_name(s):
    return an.top_people_by_rating(s.fact_performance, s.dim_title, s.dim_person, "director", 10, by_name=True)


@query("n17_productivity_quality", rating_sql("director", 5, limit=False))
def n17(s):
    return rounded(an.people_ratings(s.fact_performance, s.dim_title, s.dim_person, "director", 5), "avg_rating")


@query("n18_director_genre_affinity", f"""
WITH {GENRES}, top AS ({top_sql('director')})
SELECT t.nconst, t.primary_name, g.genre, count(*) AS genre_count FROM fact_performance f JOIN top t USING (nconst) JOIN g USING (tconst)
WHERE f.category = 'director' GROUP BY ALL""")
def n18(s):
    return an.director_genre_affinity(s.fact_performance, s.dim_title, s.dim_person)


EDGES = """top AS (SELECT nconst FROM fact_performance JOIN dim_person USING (nconst) WHERE category = 'actor' GROUP BY nconst ORDER BY count(*) DESC, nconst LIMIT 500),
casts AS (SELECT list(nconst) AS who FROM fact_performance WHERE category = 'actor' AND nconst IN (FROM top) GROUP BY tconst),
met AS (SELECT p.a, q.b FROM (SELECT who, unnest(who) AS a FROM casts) p, unnest(p.who) AS q(b) WHERE p.a < q.b),
edges AS (SELECT a, b, count(*) AS weight FROM met GROUP BY a, b HAVING count(*) > 1)"""


def graph(s):
    return an.cooccurrence_graph(s.fact_performance, s.dim_person)


@query("n19_cooccurrence_graph", f"WITH {EDGES} SELECT * FROM edges")
def n19(s):
    return graph(s)


@query("n20_degree_centrality", f"""
WITH {EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node)
SELECT node, degree, round(degree / (SELECT count(*) - 1 FROM d), 8) AS centrality FROM d""")
def n20(s):
    return rounded(an.degree_centrality(graph(s)), "centrality")


def propagation_sql(rounds):
    steps = ["l0 AS MATERIALIZED (SELECT DISTINCT node, node AS label FROM links)"]
    for i in range(1, rounds + 1):
        steps.append(f"""l{i} AS MATERIALIZED (SELECT k.node, l.label FROM links k JOIN l{i - 1} l ON l.node = k.other GROUP BY k.node, l.label
          QUALIFY row_number() OVER (PARTITION BY k.node ORDER BY sum(k.weight) DESC, l.label) = 1)""")
    return f"""WITH {EDGES}, links AS MATERIALIZED (SELECT a AS node, b AS other, weight FROM edges UNION ALL SELECT b, a, weight FROM edges),
{', '.join(steps)} SELECT node, label FROM l{rounds}"""


@query("n21_communities", propagation_sql(12))
def n21(s):
    return an.communities(graph(s))


@query("n22_actors_by_rating", rating_sql("actor", 10))
def n22(s):
    return an.top_people_by_rating(s.fact_performance, s.dim_title, s.dim_person, "actor", 10)


@query("n23_top_writers", top_sql("writer"))
def n23(s):
    return an.top_people(s.fact_performance, s.dim_person, "writer")


@query("n23_writers_by_rating", rating_sql("writer", 5))
def n23_rating(s):
    return an.top_people_by_rating(s.fact_performance, s.dim_title, s.dim_person, "writer", 5)


@query("n24_role_pair_matrix", """
WITH p AS (SELECT w.nconst AS a, d.nconst AS b, count(*) AS collab_count FROM fact_performance w JOIN fact_performance d USING (tconst)
  WHERE w.category = 'writer' AND d.category = 'director' GROUP BY ALL HAVING count(*) >= 3),
k AS (SELECT p.*, x.primary_name AS a_name, y.primary_name AS b_name FROM p JOIN dim_person x ON x.nconst = a JOIN dim_person y ON y.nconst = b
  ORDER BY collab_count DESC, a, b LIMIT 100)
SELECT * FROM k WHERE a IN (SELECT a FROM k GROUP BY a ORDER BY sum(collab_count) DESC, a LIMIT 15)
  AND b IN (SELECT b FROM k GROUP BY b ORDER BY sum(collab_count) DESC, b LIMIT 15)""")
def n24(s):
    return an.role_pair_matrix(s.fact_performance, s.dim_person, "writer", "director")


@query("n25_role_pair_ratings", f"""
SELECT w.nconst AS a, d.nconst AS b, count(*) AS freq, {AVG} FROM fact_performance w JOIN fact_performance d ON d.tconst = w.tconst
JOIN dim_title t ON t.tconst = w.tconst WHERE w.category = 'writer' AND d.category = 'director' AND t.average_rating IS NOT NULL
GROUP BY ALL HAVING count(*) >= 3""")
def n25(s):
    return rounded(an.role_pair_ratings(s.fact_performance, s.dim_title, "writer", "director"), "avg_rating")


@query("n26_career_trajectories", f"""
WITH top AS (SELECT nconst, primary_name FROM fact_performance JOIN dim_person USING (nconst) JOIN dim_title USING (tconst)
  WHERE category IN ('director', 'actor') AND start_year IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, nconst LIMIT 6)
SELECT nconst, primary_name, start_year, {AVG} FROM fact_performance JOIN top USING (nconst) JOIN dim_title USING (tconst)
WHERE start_year IS NOT NULL AND average_rating IS NOT NULL GROUP BY ALL""")
def n26(s):
    return rounded(an.career_trajectories(s.fact_performance, s.dim_title, s.dim_person), "avg_rating")


DATED = """c AS (SELECT f.nconst, f.category, d.tconst, d.start_year, d.average_rating FROM fact_performance f JOIN dim_title d USING (tconst)
  WHERE f.category IN ('director', 'actor') AND d.start_year IS NOT NULL)"""


@query("n27_career_lengths", f"""
WITH {DATED} SELECT nconst, category, max(start_year) - min(start_year) + 1 AS career_length FROM c GROUP BY ALL HAVING count(DISTINCT start_year) >= 2""")
def n27(s):
    return an.career_lengths(s.fact_performance, s.dim_title)


@query("n28_time_to_peak", f"""
WITH {DATED}, p AS (SELECT nconst, category, min(start_year) AS debut_year, (array_agg(start_year ORDER BY average_rating DESC, tconst))[1] AS peak_rating_year
  FROM c WHERE average_rating IS NOT NULL GROUP BY ALL HAVING count(*) >= 5) SELECT *, peak_rating_year - debut_year AS time_to_peak FROM p""")
def n28(s):
    return an.time_to_peak(s.fact_performance, s.dim_title)


@query("n29_career_survival", f"""
WITH {DATED}, l AS (SELECT category, max(start_year) - min(start_year) AS n FROM c GROUP BY nconst, category)
SELECT category, CAST(t AS INTEGER) AS t, round(count(*) FILTER (WHERE n > t) / count(*), 8) AS survival FROM l, range(1, 61) r(t) GROUP BY ALL""")
def n29(s):
    return rounded(an.career_survival(s.fact_performance, s.dim_title), "survival")


DOC = "coalesce(genre_list LIKE '%Documentary%', false)"


@query("n30_flag_rating_by_type", f"""
SELECT if({DOC}, 'Documentary', 'Other') AS flag, title_type, {AVG}, count(*) AS cnt FROM dim_title
WHERE average_rating IS NOT NULL AND title_type IN ('movie', 'tvSeries', 'short') GROUP BY 1, 2""")
def n30(s):
    return rounded(an.flag_rating_by_type(s.dim_title), "avg_rating")


@query("n31_flag_per_year", f"SELECT start_year, count(*) AS n FROM dim_title WHERE {DOC} AND start_year IS NOT NULL GROUP BY 1")
def n31(s):
    return an.flag_per_year(s.dim_title)


@query("n32_co_genres", f"""
SELECT genre, count(*) AS cnt FROM (SELECT unnest(string_split(genre_list, ', ')) AS genre FROM dim_title WHERE {DOC}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def n32(s):
    return an.co_genres(s.dim_title)


@query("n33_flag_runtime_rating", f"""
SELECT if({DOC}, 'Documentary', 'Other') AS flag, count(*) AS n, round(avg(runtime_minutes), 8) AS avg_runtime, {AVG},
  round(corr(runtime_minutes, average_rating), 6) AS corr FROM dim_title WHERE runtime_minutes BETWEEN 1 AND 999 AND average_rating IS NOT NULL GROUP BY 1""")
def n33(s):
    return rounded(rounded(an.flag_runtime_rating(s.dim_title), "avg_runtime", "avg_rating"), "corr", digits=6)


@query("n34_titles_per_region", f"WITH {REGIONS} SELECT region, count(*) AS title_count FROM g GROUP BY 1")
def n34(s):
    return an.titles_per_region(s.dim_title)


@query("n34_aka_per_region", f"WITH {REGIONS} SELECT region, CAST(sum(aka_count) AS BIGINT) AS total_aka FROM g WHERE aka_count IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def n34_aka(s):
    return an.aka_per_region(s.dim_title)


@query("n35_language_region_matrix", """
SELECT language, region, count(*) AS cnt FROM title_akas WHERE language IS NOT NULL AND region IS NOT NULL
  AND language IN (SELECT language FROM title_akas WHERE language IS NOT NULL AND region IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
  AND region IN (SELECT region FROM title_akas WHERE language IS NOT NULL AND region IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20) GROUP BY 1, 2""")
def n35(s):
    return an.language_region_matrix(s.title_akas)


@query("n36_region_volume_rating", f"WITH {REGIONS} SELECT region, count(*) AS title_count, {AVG} FROM g WHERE average_rating IS NOT NULL GROUP BY 1 HAVING count(*) >= 10")
def n36(s):
    return rounded(an.region_volume_rating(s.dim_title), "avg_rating")


@query("n37_type_counts", "SELECT title_type, count(*) AS cnt FROM dim_title GROUP BY 1")
def n37(s):
    return an.type_counts(s.dim_title)


PLOTTED = ", ".join(f"'{t}'" for t in an.PLOTTED_TYPES)


@query("n37_type_rating_spread", f"SELECT title_type, {box('average_rating')} FROM dim_title WHERE average_rating IS NOT NULL AND title_type IN ({PLOTTED}) GROUP BY 1")
def n37_spread(s):
    return boxed(an.type_rating_spread(s.dim_title))


@query("n37_type_share_per_year", f"""
WITH c AS (SELECT start_year, title_type, count(*) AS cnt FROM dim_title WHERE start_year IS NOT NULL AND title_type IN ({PLOTTED}) GROUP BY ALL)
SELECT *, round(cnt / sum(cnt) OVER (PARTITION BY start_year), 8) AS proportion FROM c""")
def n37_share(s):
    return rounded(an.type_share_per_year(s.dim_title), "proportion")


VOTED = "r AS (SELECT * FROM dim_title WHERE num_votes > 0 AND average_rating IS NOT NULL)"


@query("n38_popularity_quadrants", f"""
WITH {VOTED}, m AS (SELECT median(num_votes) AS v, median(average_rating) AS a FROM r)
SELECT tconst, num_votes, average_rating, if(num_votes > v, if(average_rating > a, 'Blockbuster Hits', 'Popular Duds'),
  if(average_rating > a, 'Hidden Gems', 'Obscure Failures')) AS quadrant FROM r, m""")
def n38(s):
    return an.popularity_quadrants(s.dim_title)


@query("n39_most_voted", "SELECT tconst, primary_title, num_votes FROM dim_title ORDER BY num_votes DESC NULLS LAST, tconst LIMIT 20")
def n39(s):
    return an.most_voted(s.dim_title)


@query("n39_votes_per_year", "SELECT start_year, round(avg(num_votes), 6) AS avg_votes FROM dim_title WHERE start_year IS NOT NULL AND num_votes > 0 GROUP BY 1")
def n39_year(s):
    return rounded(an.votes_per_year(s.dim_title), "avg_votes", digits=6)


@query("n40_adult_breakdown", f"SELECT if(is_adult, 'Adult', 'Non-Adult') AS adult_status, count(*) AS cnt, count(average_rating) AS rated, {AVG} FROM dim_title GROUP BY 1")
def n40(s):
    return rounded(an.adult_breakdown(s.dim_title), "avg_rating")


@query("n40_adult_genres", f"WITH {GENRES} SELECT genre, count(*) AS cnt FROM g WHERE is_adult GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def n40_genres(s):
    return an.adult_genres(s.dim_title)


@query("n40_adult_per_year", "SELECT start_year, count(*) AS adult_count FROM dim_title WHERE is_adult AND start_year IS NOT NULL GROUP BY 1")
def n40_year(s):
    return an.adult_per_year(s.dim_title)


@query("n41_bayesian_top", f"""
WITH {VOTED}, p AS (SELECT round(avg(average_rating), 2) AS c, median(num_votes) AS m FROM r)
SELECT tconst, primary_title, start_year, average_rating AS rating, num_votes AS votes,
  round((num_votes * average_rating + m * c) / (num_votes + m), 2) AS weighted_rating FROM r, p ORDER BY weighted_rating DESC, votes DESC, tconst LIMIT 20""")
def n41(s):
    return an.bayesian_top(s.dim_title)


@query("n41_segment_summary", f"""
SELECT CASE WHEN num_votes >= 100000 THEN 'high' WHEN num_votes >= 10000 THEN 'medium' WHEN num_votes > 0 THEN 'low' ELSE 'unrated' END AS segment,
  count(*) AS cnt, {AVG}, round(avg(num_votes), 6) AS avg_votes,
  (SELECT round(corr(num_votes, average_rating), 6) FROM dim_title WHERE num_votes > 0 AND average_rating IS NOT NULL) AS corr
FROM dim_title WHERE average_rating IS NOT NULL GROUP BY 1""")
def n41_segments(s):
    return rounded(rounded(an.segment_summary(s.dim_title), "avg_rating"), "avg_votes", "corr", digits=6)
