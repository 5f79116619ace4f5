"""Ordering, pages and set operators."""

from pyspark.sql import functions as F

from marquee.operators import joins, paging
from marquee.plans import marts
from marquee.suite.core import query



@query("g01_top_n", """
SELECT tconst, primary_title, num_votes FROM dim_title ORDER BY num_votes DESC NULLS LAST, tconst LIMIT 50""")
def g01(s):
    titles = s.dim_title.select("tconst", "primary_title", "num_votes")
    return paging.top_n(titles, [F.desc_nulls_last("num_votes"), F.asc("tconst")], 50)


@query("g02_page", """
WITH m AS (SELECT tconst, average_rating FROM dim_title WHERE title_type = 'movie')
SELECT m.*, c.n AS total, CASE WHEN 150 < c.n THEN CAST(150 AS BIGINT) END AS next_offset FROM m, (SELECT count(*) AS n FROM m) c
ORDER BY average_rating DESC NULLS LAST, tconst LIMIT 50 OFFSET 100""")
def g02(s):
    movies = s.dim_title.filter("title_type = 'movie'").select("tconst", "average_rating")
    return paging.page(movies, paging.browse_sort("rating"), first=50, offset=100)


@query("g03_browse_sorts", """
SELECT 'rating' AS sort, tconst FROM (FROM dim_title ORDER BY average_rating DESC NULLS LAST, tconst LIMIT 20)
UNION ALL SELECT 'title', tconst FROM (FROM dim_title ORDER BY primary_title, tconst LIMIT 20)
UNION ALL SELECT 'votes', tconst FROM (FROM dim_title ORDER BY num_votes DESC NULLS LAST, tconst LIMIT 20)
UNION ALL SELECT 'year', tconst FROM (FROM dim_title ORDER BY start_year DESC NULLS LAST, tconst LIMIT 20)""")
def g03(s):
    lists = [
        paging.top_n(s.dim_title, paging.browse_sort(name), 20).select(F.lit(name).alias("sort"), "tconst")
        for name in paging.BROWSE_SORTS
    ]
    return paging.union_all(lists)


@query("g04_first_keys", "SELECT tconst FROM dim_title WHERE start_year IS NOT NULL ORDER BY tconst LIMIT 250000")
def g04(s):
    return paging.first_keys(s.dim_title.filter("start_year IS NOT NULL"), "tconst", 250_000)


@query("g05_random_rows", """
SELECT tconst, primary_title FROM dim_title ORDER BY md5('42:' || CAST(tconst AS VARCHAR)), tconst LIMIT 100""")
def g05(s):
    return paging.random_rows(s.dim_title.select("tconst", "primary_title"), 100, seed=42, key="tconst")


ORPHANS_SQL = "SELECT '{name}' AS fk_check, count(*) AS orphan_count FROM {table} x WHERE NOT EXISTS (SELECT 1 FROM title_basics b WHERE b.is_current AND b.tconst = x.{key})"


@query("x01_union_all", " UNION ALL ".join([
    ORPHANS_SQL.format(name="title_episode", table="title_episode", key="parent_tconst"),
    ORPHANS_SQL.format(name="title_rating", table="title_rating", key="tconst"),
    ORPHANS_SQL.format(name="title_principal", table="title_principal", key="tconst"),
]))
def x01(s):
    titles = marts.current(s.title_basics)
    checks = {
        "title_episode": (s.title_episode, "parent_tconst"),
        "title_rating": (s.title_rating, "tconst"),
        "title_principal": (s.title_principal, "tconst"),
    }
    return paging.union_all([
        joins.orphans(child, titles, key, "tconst").agg(F.count("*").alias("orphan_count")).withColumn("fk_check", F.lit(name))
        for name, (child, key) in checks.items()
    ])


@query("x02_distinct_rows", "SELECT tconst, nconst FROM fact_performance GROUP BY tconst, nconst")
def x02(s):
    return paging.distinct_rows(s.fact_performance, ["tconst", "nconst"])


@query("x03_merge_unique", """
SELECT tconst, origin FROM (
  SELECT tconst, 1 AS p, 'votes' AS origin FROM dim_title WHERE num_votes > 50000
  UNION ALL SELECT tconst, 2, 'genre' FROM dim_title WHERE genre_list LIKE '%Documentary%')
QUALIFY row_number() OVER (PARTITION BY tconst ORDER BY p) = 1""")
def x03(s):
    voted = s.dim_title.filter("num_votes > 50000").select("tconst", F.lit("votes").alias("origin"))
    genre = s.dim_title.filter("genre_list LIKE '%Documentary%'").select("tconst", F.lit("genre").alias("origin"))
    return paging.merge_unique([voted, genre], "tconst")


@query("x04_same_keys", """
WITH a AS (SELECT DISTINCT tconst AS k FROM dim_title), b AS (SELECT DISTINCT tconst AS k FROM fact_performance),
d AS (SELECT (SELECT count(*) FROM a WHERE k NOT IN (FROM b)) AS only_left, (SELECT count(*) FROM b WHERE k NOT IN (FROM a)) AS only_right)
SELECT *, only_left + only_right = 0 AS equal FROM d""")
def x04(s):
    return paging.same_keys(s.dim_title, s.fact_performance, "tconst")
