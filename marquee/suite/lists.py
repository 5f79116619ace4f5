"""List columns as child tables."""

from pyspark.sql import functions as F

from marquee.operators import normalize as nz
from marquee.suite.core import query

N = "chr(92) || 'N'"


@query("c01_title_genre", f"""
SELECT DISTINCT tconst, unnest(string_split(genres, ',')) AS genre FROM title_basics WHERE genres <> {N}""")
def c01(s):
    return nz.normalize_set(s.title_basics, ["tconst"], "genres", "genre")


def ordered_sql(table, key, column, name, ordinal):
    return f"""
SELECT {key}, {name}, {ordinal} FROM (SELECT {key}, unnest(string_split({column}, ',')) AS {name},
  CAST(generate_subscripts(string_split({column}, ','), 1) AS INTEGER) AS {ordinal} FROM {table} WHERE {column} <> {N}) WHERE {name} <> ''"""


@query("c02_title_director", ordered_sql("title_crew_raw", "tconst", "directors", "nconst", "ordering"))
def c02_director(s):
    return nz.normalize_ordered(s.title_crew_raw, ["tconst"], "directors", "nconst")


@query("c02_title_writer", ordered_sql("title_crew_raw", "tconst", "writers", "nconst", "ordering"))
def c02_writer(s):
    return nz.normalize_ordered(s.title_crew_raw, ["tconst"], "writers", "nconst")


@query("c02_name_profession", ordered_sql("name_basics", "nconst", "primary_profession", "profession", "profession_order"))
def c02_profession(s):
    return nz.normalize_ordered(s.name_basics, ["nconst"], "primary_profession", "profession", "profession_order")


@query("c02_name_known_for", ordered_sql("name_basics", "nconst", "known_for", "tconst", "known_for_order"))
def c02_known_for(s):
    return nz.normalize_ordered(s.name_basics, ["nconst"], "known_for", "tconst", "known_for_order")


@query("c03_akas_type", """
SELECT DISTINCT title_id, ordering, trim(unnest(string_split(types, ','))) AS type FROM title_akas""")
def c03_type(s):
    return nz.normalize_set(s.title_akas, ["title_id", "ordering"], "types", "type")


@query("c03_akas_attribute", """
SELECT DISTINCT title_id, ordering, trim(unnest(string_split(attributes, ','))) AS attribute FROM title_akas""")
def c03_attribute(s):
    return nz.normalize_set(s.title_akas, ["title_id", "ordering"], "attributes", "attribute")


CHARACTER_SQL = """
SELECT DISTINCT tconst, ordering, unnest(CAST(characters AS JSON)::VARCHAR[]) AS character_name FROM title_principal
WHERE characters IS NOT NULL"""


@query("c04_principal_character", CHARACTER_SQL)
def c04(s):
    return nz.normalize_json_list(s.title_principal, ["tconst", "ordering"], "characters", "character_name")


@query("c04_principal_character_json", CHARACTER_SQL)
def c04_strict(s):
    return nz.normalize_json_list(s.title_principal, ["tconst", "ordering"], "characters", "character_name", strict=True)


@query("c05_explode_zip", """
SELECT tconst, unnest(string_split(language_list, ', ')) AS language_list, unnest(string_split(region_list, ', ')) AS region_list
FROM dim_title WHERE language_list IS NOT NULL OR region_list IS NOT NULL""")
def c05(s):
    return nz.explode_zip(s.dim_title, "language_list", "region_list", keep=["tconst"])


@query("c06_shard_distinct", "SELECT DISTINCT title_id, region FROM title_akas")
def c06(s):
    return nz.shard(s.title_akas.select("title_id", "region"), "title_id", 16).distinct()


@query("c07_multi_hot", """
WITH v AS (SELECT DISTINCT unnest(string_split(genre_list, ', ')) AS item FROM dim_title WHERE start_year <= 1996)
SELECT * FROM (SELECT DISTINCT tconst, unnest(string_split(genre_list, ', ')) AS item FROM dim_title)
WHERE item IN (SELECT item FROM v)""")
def c07(s):
    vocab = nz.vocabulary(s.dim_title.filter("start_year <= 1996"), "genre_list")
    return nz.multi_hot_long(s.dim_title, "tconst", "genre_list", vocab)


@query("c07_multi_hot_vector", """
WITH v AS (SELECT DISTINCT unnest(string_split(genre_list, ', ')) AS item FROM dim_title WHERE start_year <= 2014)
SELECT tconst, CAST(count(DISTINCT v.item) AS DOUBLE) AS ones FROM
  (SELECT tconst, unnest(CASE WHEN genre_list IS NULL THEN [NULL] ELSE string_split(genre_list, ', ') END) AS item FROM dim_title) t
  LEFT JOIN v ON v.item = t.item GROUP BY tconst""")
def c07_vector(s):
    from pyspark.ml.functions import vector_to_array

    coded, _ = nz.multi_hot(s.dim_title, "genre_list", F.col("start_year") <= 2014)
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x)
    return coded.select("tconst", total.alias("ones"))
