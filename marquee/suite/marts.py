"""Marts from the normalised tables."""

from marquee.operators.normalize import normalize_json_list, normalize_ordered, normalize_set
from marquee.plans import marts
from marquee.suite.core import query


def title_genre(s):
    return normalize_set(s.title_basics, ["tconst"], "genres", "genre")


def people_of(s, column):
    listed = normalize_ordered(s.title_crew_raw, ["tconst"], column, "nconst")
    return listed.withColumn("nconst", listed.nconst.try_cast("bigint"))


def title_inputs(s):
    return (
        s.title_basics, title_genre(s), s.title_akas, people_of(s, "directors"), people_of(s, "writers"),
        s.name_basics, s.title_rating, s.title_episode,
    )


def person_inputs(s):
    profession = normalize_ordered(s.name_basics, ["nconst"], "primary_profession", "profession", "profession_order")
    known = normalize_ordered(s.name_basics, ["nconst"], "known_for", "tconst", "known_for_order")
    return s.name_basics, profession, known.withColumn("tconst", known.tconst.cast("bigint")), s.title_basics


def characters(s):
    return normalize_json_list(s.title_principal, ["tconst", "ordering"], "characters", "character_name")


CREW_SQL = """
  (SELECT tconst, string_agg(primary_name, ', ' ORDER BY pos) AS names FROM (
     SELECT c.tconst, i.pos, n.primary_name
     FROM (SELECT tconst, string_split({col}, ',') AS l FROM title_crew_raw
           WHERE {col} IS NOT NULL AND {col} NOT IN ('', chr(92) || 'N')) c,
          LATERAL (SELECT unnest(l) AS nconst, generate_subscripts(l, 1) AS pos) i
     JOIN name_basics n ON n.nconst = CAST(i.nconst AS BIGINT) AND n.is_current) GROUP BY tconst)"""

DIM_TITLE_SQL = f"""
WITH cur AS (SELECT * FROM title_basics WHERE is_current),
g AS (SELECT tconst, array_to_string(list_sort(string_split(genres, ',')), ', ') AS genre_list
      FROM title_basics WHERE genres IS NOT NULL),
aka_pairs AS (SELECT title_id, region, language, count(*) AS n FROM title_akas GROUP BY ALL),
rg AS (SELECT title_id,
          string_agg(region, ', ' ORDER BY region, coalesce(language, '')) FILTER (WHERE region IS NOT NULL) AS region_list,
          string_agg(language, ', ' ORDER BY region, coalesce(language, '')) FILTER (WHERE region IS NOT NULL) AS language_list,
          count(region) AS aka_count, CAST(sum(n) AS BIGINT) AS aka_rows
       FROM aka_pairs GROUP BY title_id),
ser AS (SELECT tconst, primary_title FROM cur WHERE title_type IN ('tvSeries', 'tvMiniSeries')),
r AS (SELECT * FROM title_rating WHERE snapshot_date = DATE '2024-03-01')
SELECT t.tconst, t.title_type, t.primary_title, t.original_title, t.is_adult, t.start_year, t.end_year, t.runtime_minutes,
  g.genre_list, d.names AS director_names, w.names AS writer_names, r.average_rating, r.num_votes,
  CASE WHEN r.num_votes >= 100000 THEN 'high' WHEN r.num_votes >= 10000 THEN 'medium' WHEN r.num_votes >= 0 THEN 'low' ELSE 'unknown' END AS popularity_segment,
  CASE WHEN r.average_rating >= 8 THEN 'excellent' WHEN r.average_rating >= 6 THEN 'good' WHEN r.average_rating >= 0 THEN 'average' ELSE 'unrated' END AS rating_bucket,
  e.parent_tconst, ser.primary_title AS series_title, e.season_number, e.episode_number,
  rg.region_list, rg.language_list, CASE WHEN rg.aka_count > 0 THEN rg.aka_count END AS aka_count, rg.aka_rows
FROM cur t LEFT JOIN g ON g.tconst = t.tconst
  LEFT JOIN {CREW_SQL.format(col='directors')} d ON d.tconst = t.tconst
  LEFT JOIN {CREW_SQL.format(col='writers')} w ON w.tconst = t.tconst
  LEFT JOIN r ON r.tconst = t.tconst LEFT JOIN title_episode e ON e.tconst = t.tconst
  LEFT JOIN ser ON ser.tconst = e.parent_tconst LEFT JOIN rg ON rg.title_id = t.tconst
"""


@query("w01_dim_title", DIM_TITLE_SQL)
def w01(s):
    return marts.dim_title(*title_inputs(s))


DIM_PERSON_SQL = """
WITH kf AS (
  SELECT n.nconst, i.pos, CAST(i.t AS BIGINT) AS tconst FROM
    (SELECT nconst, string_split(known_for, ',') AS l FROM name_basics WHERE known_for IS NOT NULL) n,
    LATERAL (SELECT unnest(l) AS t, generate_subscripts(l, 1) AS pos) i),
k AS (SELECT kf.nconst, string_agg(t.primary_title, ', ' ORDER BY pos) AS known_for_titles,
        string_agg(CAST(kf.tconst AS VARCHAR), ',' ORDER BY pos) AS known_for_ids
      FROM kf LEFT JOIN title_basics t ON t.tconst = kf.tconst AND t.is_current GROUP BY kf.nconst)
SELECT n.nconst, n.primary_name, n.birth_year, n.death_year, n.death_year - n.birth_year AS age_at_death,
  CASE WHEN birth_year IS NULL THEN NULL WHEN birth_year < 1946 THEN 'Silent/Greatest' WHEN birth_year < 1965 THEN 'Boomer'
       WHEN birth_year < 1981 THEN 'Gen X' WHEN birth_year < 1997 THEN 'Millennial' WHEN birth_year < 2010 THEN 'Gen Z'
       ELSE 'Gen Alpha' END AS generation,
  replace(n.primary_profession, ',', ', ') AS profession_list, k.known_for_titles, k.known_for_ids
FROM name_basics n LEFT JOIN k ON k.nconst = n.nconst WHERE n.is_current
"""


@query("w02_dim_person", DIM_PERSON_SQL)
def w02(s):
    return marts.dim_person(*person_inputs(s))


@query("w03_fact_title_rating", """
SELECT tconst AS title_key, snapshot_date, average_rating, num_votes, batch_id, ingested_at FROM title_rating""")
def w03(s):
    return marts.fact_title_rating(s.title_rating)


# Every planted list names at most two roles, so the check spells out their order.
CHARS_SQL = """
chars AS (SELECT DISTINCT tconst, ordering, trim(c, '"') AS character_name FROM
  (SELECT tconst, ordering, unnest(string_split(trim(characters, '[]'), '","')) AS c FROM title_principal
   WHERE characters IS NOT NULL))"""


@query("w04_fact_title_principal", f"""
WITH {CHARS_SQL}
SELECT p.tconst AS title_key, p.nconst AS name_key,
  (SELECT string_agg(c.character_name, ', ' ORDER BY c.character_name) FROM chars c
   WHERE c.tconst = p.tconst AND c.ordering = p.ordering) AS character_name,
  p.ordering, p.category, p.job, p.batch_id, p.ingested_at
FROM title_principal p""")
def w04(s):
    return marts.fact_title_principal(s.title_principal, characters(s))


@query("w05_fact_performance", f"""
WITH {CHARS_SQL}
SELECT p.tconst, p.ordering, p.nconst, p.category, p.job, c.character_name,
  ifnull(p.batch_id, 'legacy') AS batch_id, ifnull(p.ingested_at, TIMESTAMP '1970-01-01') AS ingested_at
FROM title_principal p LEFT JOIN chars c USING (tconst, ordering)""")
def w05(s):
    return marts.fact_performance(s.title_principal, characters(s))


@query("w06_fact_episode", """
SELECT e.tconst AS episode_key, e.parent_tconst AS series_key, e.season_number, e.episode_number,
  p.primary_title AS series_title, p.start_year AS series_start_year, p.title_type AS series_type, e.batch_id, e.ingested_at
FROM title_episode e LEFT JOIN (SELECT * FROM title_basics WHERE is_current AND title_type LIKE '%Series') p
  ON p.tconst = e.parent_tconst""")
def w06(s):
    return marts.fact_episode(s.title_episode, s.title_basics)


@query("w07_actor_cooccurrence", """
WITH cast_of AS (SELECT tconst, list(DISTINCT nconst) AS l FROM fact_performance
                 WHERE category IN ('actor', 'actress') GROUP BY tconst),
p AS (SELECT x.tconst, x.a, y.b FROM (SELECT tconst, unnest(l) AS a FROM cast_of) x
      JOIN (SELECT tconst, unnest(l) AS b FROM cast_of) y ON y.tconst = x.tconst AND y.b > x.a)
SELECT p.a AS actor_a_nconst, na.primary_name AS actor_a_name, p.b AS actor_b_nconst, nb.primary_name AS actor_b_name,
  p.tconst AS shared_title, t.title_type, t.start_year, t.average_rating, t.num_votes,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY t.num_votes DESC NULLS LAST, p.tconst) AS collaboration_rank,
  count(*) OVER (PARTITION BY p.a, p.b) AS total_collaborations
FROM p LEFT JOIN dim_title t ON t.tconst = p.tconst
  LEFT JOIN dim_person na ON na.nconst = p.a LEFT JOIN dim_person nb ON nb.nconst = p.b""")
def w07(s):
    return marts.actor_cooccurrence(s.fact_performance, s.dim_title, s.dim_person)
