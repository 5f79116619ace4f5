"""Cleaning, labelling and list columns."""

from pyspark.sql import functions as F

from marquee.functions import scalars as sc
from marquee.operators import joins
from marquee.operators.ordering import exact_quantiles
from marquee.suite.core import query

N = "chr(92) || 'N'"


@query("b01_clean_nulls", f"""
SELECT nullif(tconst, {N}) AS tconst, nullif("titleType", {N}) AS "titleType", nullif("primaryTitle", {N}) AS "primaryTitle",
  nullif("originalTitle", {N}) AS "originalTitle", nullif("isAdult", {N}) AS "isAdult", nullif("startYear", {N}) AS "startYear",
  nullif("endYear", {N}) AS "endYear", nullif("runtimeMinutes", {N}) AS "runtimeMinutes", nullif(genres, {N}) AS genres
FROM title_basics_raw""")
def b01(s):
    return sc.clean_nulls(s.title_basics_raw)


@query("b02_fill_defaults", f"""
SELECT tconst, CASE WHEN "isAdult" = {N} THEN '0' ELSE "isAdult" END AS "isAdult",
  CASE WHEN "primaryTitle" = {N} THEN 'Untitled' ELSE "primaryTitle" END AS "primaryTitle" FROM title_basics_raw""")
def b02(s):
    raw = s.title_basics_raw.select("tconst", "isAdult", "primaryTitle")
    cleaned = sc.clean_nulls(raw, columns=["isAdult", "primaryTitle"])
    return sc.fill_defaults(cleaned, {"isAdult": "0", "primaryTitle": "Untitled"})


@query("b03_to_flag", """
SELECT tconst, "isAdult", CASE "isAdult" WHEN '1' THEN true ELSE false END AS is_adult FROM title_basics_raw""")
def b03(s):
    return s.title_basics_raw.select("tconst", "isAdult", sc.to_flag("isAdult").alias("is_adult"))


@query("b04_require_key", f"""
SELECT 'kept' AS side, "titleType", count(*) AS n FROM title_basics_raw
WHERE tconst NOT IN ('', {N}) GROUP BY ALL
UNION ALL SELECT 'quarantine', "titleType", count(*) FROM title_basics_raw
WHERE tconst IS NULL OR tconst IN ('', {N}) GROUP BY ALL""")
def b04(s):
    sides = sc.require(s.title_basics_raw, "tconst")
    kept, bad = [d.withColumn("side", F.lit(n)) for d, n in zip(sides, ("kept", "quarantine"))]
    return kept.unionByName(bad).groupBy("side", "titleType").agg(F.count("*").alias("n"))


@query("b05_cast_columns", """
SELECT tconst, try_cast("startYear" AS INTEGER) AS "startYear", try_cast("endYear" AS INTEGER) AS "endYear",
  try_cast("runtimeMinutes" AS INTEGER) AS "runtimeMinutes" FROM title_basics_raw""")
def b05(s):
    raw = s.title_basics_raw.select("tconst", "startYear", "endYear", "runtimeMinutes")
    return sc.cast_columns(raw, {"startYear": "int", "endYear": "int", "runtimeMinutes": "int"})


@query("b06_popularity_segment", "SELECT tconst, num_votes, popularity_segment AS segment FROM dim_title")
def b06(s):
    return s.dim_title.select("tconst", "num_votes", sc.popularity_segment("num_votes").alias("segment"))


@query("b07_rating_bucket", "SELECT tconst, average_rating, rating_bucket AS bucket FROM dim_title")
def b07(s):
    return s.dim_title.select("tconst", "average_rating", sc.rating_bucket("average_rating").alias("bucket"))


@query("b08_generation", """
SELECT nconst, birth_year, CASE WHEN birth_year IS NULL THEN NULL WHEN birth_year < 1946 THEN 'Silent/Greatest'
  WHEN birth_year < 1965 THEN 'Boomer' WHEN birth_year < 1981 THEN 'Gen X' WHEN birth_year < 1997 THEN 'Millennial'
  WHEN birth_year < 2010 THEN 'Gen Z' ELSE 'Gen Alpha' END AS generation FROM dim_person""")
def b08(s):
    return s.dim_person.select("nconst", "birth_year", sc.generation("birth_year").alias("generation"))


@query("b09_age_at_death", "SELECT nconst, death_year - birth_year AS age_at_death FROM dim_person")
def b09(s):
    return s.dim_person.select("nconst", sc.age_at_death("birth_year", "death_year").alias("age_at_death"))


@query("b10_decade", "SELECT tconst, start_year, CAST(start_year // 10 * 10 AS INTEGER) AS decade FROM dim_title")
def b10(s):
    return s.dim_title.select("tconst", "start_year", sc.decade("start_year").alias("decade"))


FICTION = ", ".join(f"'{g}'" for g in sc.FICTION_GENRES)
NONFICTION = ", ".join(f"'{g}'" for g in sc.NONFICTION_GENRES)


@query("b11_genre_class", f"""
SELECT tconst, g AS genre, CASE WHEN g IN ({FICTION}) THEN 'Fiction' WHEN g IN ({NONFICTION}) THEN 'Non-fiction'
  ELSE 'Other' END AS class FROM (SELECT tconst, unnest(string_split(genre_list, ', ')) AS g FROM dim_title)""")
def b11(s):
    genres = s.dim_title.select("tconst", F.explode(sc.split_list("genre_list")).alias("genre"))
    return genres.withColumn("class", sc.genre_class("genre"))


@query("b12_title_class", f"""
SELECT tconst, CASE WHEN list_has_any(string_split(genre_list, ', '), [{NONFICTION}]) THEN 'Non-fiction'
  WHEN list_has_any(string_split(genre_list, ', '), [{FICTION}]) THEN 'Fiction' ELSE 'Other' END AS class FROM dim_title""")
def b12(s):
    return s.dim_title.select("tconst", sc.title_class(sc.split_list("genre_list")).alias("class"))


@query("b13_ilike_contains", """
SELECT tconst, primary_title FROM dim_title WHERE contains(lower(primary_title), '0% story_')""")
def b13(s):
    return s.dim_title.filter(sc.ilike_contains("primary_title", "0% sTORY_")).select("tconst", "primary_title")


@query("b14_id_format", """
SELECT regexp_matches(tconst, '^tt[0-9]+$') AS valid, count(*) AS n FROM title_basics_raw GROUP BY ALL""")
def b14(s):
    valid = sc.matches("tconst", "^tt[0-9]+$").alias("valid")
    return s.title_basics_raw.groupBy(valid).agg(F.count("*").alias("n"))


def votes_and_rating(s):
    return s.dim_title.filter("num_votes > 0 AND average_rating IS NOT NULL")


def weighted(s):
    rated = votes_and_rating(s)
    priors = rated.agg(F.round(F.avg("average_rating"), 2).alias("prior_rating"))
    median = exact_quantiles(rated, "num_votes", [0.5]).select(F.col("q0").alias("prior_votes"))
    both = joins.cross_scalar(joins.cross_scalar(rated, priors), median)
    score = sc.weighted_rating(F.col("average_rating"), F.col("num_votes"), F.col("prior_rating"), F.col("prior_votes"))
    return both.withColumn("weighted_rating", F.round(score, 4))


@query("b15_weighted_rating", """
WITH r AS (SELECT * FROM dim_title WHERE num_votes > 0 AND average_rating IS NOT NULL),
p AS (SELECT round(avg(average_rating), 2) AS c, quantile_cont(num_votes, 0.5) AS m FROM r)
SELECT tconst, round((num_votes * average_rating + m * c) / (num_votes + m), 4) AS weighted_rating FROM r, p""")
def b15(s):
    return weighted(s).select("tconst", "weighted_rating")


def quadrants(s):
    rated = votes_and_rating(s)
    votes = exact_quantiles(rated, "num_votes", [0.5]).select(F.col("q0").alias("mid_votes"))
    rating = rated.agg(F.median("average_rating").alias("mid_rating"))  # at most 91 distinct ratings
    both = joins.cross_scalar(joins.cross_scalar(rated, votes), rating)
    cols = [F.col(c) for c in ("num_votes", "average_rating", "mid_votes", "mid_rating")]
    return both.withColumn("quadrant", sc.quadrant(*cols))


@query("b16_quadrants", """
WITH r AS (SELECT * FROM dim_title WHERE num_votes > 0 AND average_rating IS NOT NULL),
m AS (SELECT median(num_votes) AS v, median(average_rating) AS a FROM r)
SELECT tconst, CASE WHEN average_rating > a AND num_votes > v THEN 'Blockbuster Hits' WHEN average_rating > a THEN 'Hidden Gems'
  WHEN num_votes > v THEN 'Popular Duds' ELSE 'Obscure Failures' END AS quadrant FROM r, m""")
def b16(s):
    return quadrants(s).select("tconst", "quadrant")


@query("b17_split_list", """
SELECT tconst, array_to_string(string_split(genre_list, ', '), '/') AS genres, len(string_split(genre_list, ', ')) AS n
FROM dim_title""")
def b17(s):
    items = sc.split_list("genre_list")
    return s.dim_title.select("tconst", F.array_join(items, "/").alias("genres"), F.size(items).cast("long").alias("n"))


@query("b18_list_size", "SELECT tconst, len(string_split(coalesce(genre_list, ''), ',')) AS genre_cnt FROM dim_title")
def b18(s):
    return s.dim_title.select("tconst", sc.list_size("genre_list").cast("long").alias("genre_cnt"))


@query("b19_career_length", """
SELECT f.nconst, max(start_year) - min(start_year) AS career_length FROM fact_performance f JOIN dim_title d USING (tconst)
WHERE start_year IS NOT NULL GROUP BY f.nconst""")
def b19(s):
    dated = s.dim_title.filter("start_year IS NOT NULL").select("tconst", "start_year")
    years = s.fact_performance.select("tconst", "nconst").join(dated, "tconst")
    span = years.groupBy("nconst").agg(F.min("start_year").alias("a"), F.max("start_year").alias("b"))
    return span.select("nconst", sc.career_length("a", "b").alias("career_length"))


@query("b20_clamp", """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity / 4 < 1 THEN 1 WHEN l_quantity / 4 > 10 THEN 10
  ELSE l_quantity / 4 END, 4) AS score FROM lineitem""")
def b20(s):
    score = F.round(sc.clamp(F.col("l_quantity") / 4, 1.0, 10.0), 4).alias("score")
    return s.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", score)


@query("b21_has_item", """
SELECT tconst, coalesce(list_contains(string_split(genre_list, ', '), 'Documentary'), false) AS documentary FROM dim_title""")
def b21(s):
    return s.dim_title.select("tconst", sc.has_item("genre_list", "Documentary").alias("documentary"))


@query("b22_audit_defaults", """
SELECT tconst, ordering, nconst, CASE WHEN batch_id IS NULL THEN 'legacy' ELSE batch_id END AS batch_id,
  CASE WHEN ingested_at IS NULL THEN TIMESTAMP '1970-01-01' ELSE ingested_at END AS ingested_at FROM title_principal""")
def b22(s):
    return sc.audit_defaults(s.title_principal.select("tconst", "ordering", "nconst", "batch_id", "ingested_at"))


@query("b23_attr_hash", """
SELECT nconst, md5(concat(primary_name, '|', ifnull(CAST(birth_year AS VARCHAR), ''), '|', ifnull(CAST(death_year AS VARCHAR), ''),
  '|', ifnull(primary_profession, ''))) AS attr_hash FROM name_basics""")
def b23(s):
    return s.name_basics.select(
        "nconst", sc.attr_hash(["primary_name", "birth_year", "death_year", "primary_profession"]).alias("attr_hash")
    )
