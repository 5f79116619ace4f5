"""Binds the driver's tables to catalogue-shaped inputs.

Every bound table is a row-local projection of one source table, so the scan prunes columns and no shuffle
is added. Each expression is written once, in SQL that Spark and DuckDB read alike, because the check
queries need the same inputs. Nulls, orphans and invalid values are planted by key modulus so that the quality
checks have something to find.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "concat(chr(92), 'N')"  # the null marker of the raw files


def _pick(index: str, values: list[str | None]) -> str:
    """CASE over a small index; ``None`` gives NULL."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {index} {arms} END"


def _raw(expr: str) -> str:
    return f"coalesce(CAST({expr} AS STRING), {MARK})"


PRICE = "CAST(floor(o_totalprice) AS BIGINT)"
TITLE_TYPE = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'movie'"
    " WHEN '2-HIGH' THEN CASE WHEN o_orderstatus = 'P' THEN 'tvMiniSeries' ELSE 'tvSeries' END"
    " WHEN '3-MEDIUM' THEN 'tvEpisode'"
    " WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'O' THEN 'short' WHEN 'F' THEN 'video' ELSE 'tvSpecial' END"
    " ELSE CASE WHEN o_orderstatus = 'O' THEN 'movie' ELSE 'tvMovie' END END"
)
TITLE_NAME = (
    "CASE WHEN o_custkey % 50 = 0 THEN concat('100% Story_', CAST(o_custkey AS STRING))"
    " ELSE concat('Story ', CAST(o_custkey AS STRING)) END"
)
START_YEAR = "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(year(o_orderdate) + o_custkey % 20 AS INT) END"
END_YEAR = (
    "CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 3 <> 0"
    " THEN CAST(year(o_orderdate) + o_custkey % 20 + o_orderkey % 7 - 1 AS INT) END"
)
RUNTIME = (
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 0"
    f" WHEN o_orderkey % 997 = 5 THEN 1200 ELSE CAST(20 + {PRICE} % 181 AS INT) END"
)
GENRE_1 = _pick("o_custkey % 9", ["Drama", "Comedy", "Action", "Documentary", "Horror", "Romance", "Thriller", "Animation"])
GENRE_2 = _pick("o_orderkey % 11", ["Crime", "Adventure", "News", "Family", "Reality-TV", "Music", "History"])
GENRE_3 = _pick(f"{PRICE} % 23", ["Short", "Adult", "Sci-Fi", "Western"])
GENRES_GOLD = f"nullif(concat_ws(', ', {GENRE_1}, {GENRE_2}, {GENRE_3}), '')"
GENRES_RAW = f"nullif(concat_ws(',', {GENRE_1}, {GENRE_2}, {GENRE_3}), '')"
RATED = "o_orderkey % 10 <> 3"
RATING = f"CASE WHEN {RATED} THEN CAST(10 + {PRICE} % 91 AS DOUBLE) / 10 END"
VOTES = f"CASE WHEN {RATED} THEN {PRICE} % 1009 * (o_orderkey % 211 + 1) END"
REGIONS = (
    "nullif(concat_ws(', ', "
    + _pick("o_custkey % 6", ["US", "GB", "DE", "FR", "JP"])
    + ", "
    + _pick("o_orderkey % 8", ["IN", "BR", "IT", "ES", "CA"])
    + "), '')"
)
LANGUAGES = (
    "nullif(concat_ws(', ', "
    + _pick("o_custkey % 5", ["en", "de", "fr", "ja"])
    + ", "
    + _pick("o_orderkey % 7", ["hi", "pt", "it", "es"])
    + "), '')"
)
PARENT = (
    "CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 9000000000000 + o_orderkey"
    " ELSE o_orderkey - o_orderkey % 60 END"
)
SEASON = (
    "CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN -1"
    " ELSE CAST(1 + o_orderkey % 5 AS INT) END"
)
EPISODE = "CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS INT) END"
IS_EPISODE = "o_orderpriority = '3-MEDIUM'"

PERSON = "CASE WHEN l_partkey % 499 = 0 THEN 9000000000000 + l_suppkey ELSE l_suppkey END"
CATEGORY = (
    "CASE concat(l_returnflag, l_linestatus) WHEN 'RO' THEN 'actor' WHEN 'NF' THEN 'actress'"
    " WHEN 'AO' THEN 'director' WHEN 'NO' THEN 'writer'"
    " WHEN 'RF' THEN CASE WHEN l_linenumber <= 5 THEN 'actor' ELSE 'cinematographer' END"
    " ELSE CASE l_linenumber WHEN 1 THEN 'self' WHEN 2 THEN 'producer' WHEN 3 THEN 'composer' WHEN 4 THEN 'editor'"
    " WHEN 5 THEN 'archive_footage' WHEN 6 THEN 'archive_sound' ELSE 'producer' END END"
)
JOB = "CASE WHEN l_partkey % 4 = 0 THEN concat('job ', CAST(l_partkey % 9 AS STRING)) END"
ACTING = "(concat(l_returnflag, l_linestatus) IN ('RO', 'NF') OR (concat(l_returnflag, l_linestatus) = 'RF' AND l_linenumber <= 5))"
CHARACTERS = (
    f"CASE WHEN {ACTING} THEN CASE l_partkey % 4"
    " WHEN 0 THEN concat('[\"Role ', CAST(l_partkey % 30 AS STRING), '\"]')"
    " WHEN 1 THEN concat('[\"Role ', CAST(l_partkey % 30 AS STRING), '\",\"Self, as ', CAST(l_linenumber AS STRING), '\"]')"
    " WHEN 2 THEN '[\"Twin\",\"Twin\"]' END END"
)
AKA_REGION = _pick("l_suppkey % 9", ["US", "GB", "DE", "FR", "JP", "IN", "BR"])
AKA_LANGUAGE = _pick("l_partkey % 7", ["en", "de", "fr", "ja", "hi"])
AKA_TYPES = _pick("l_partkey % 5", ["display", "alternative,working", "dvd, dvd"])
AKA_ATTRS = _pick("l_suppkey % 11", ["literal title", "short title,reissue title"])

PERSON_NAME = "CASE WHEN s_suppkey % 10 = 9 THEN concat('Namesake ', CAST(s_nationkey AS STRING)) ELSE s_name END"
BIRTH = "CASE WHEN s_suppkey % 11 = 4 THEN NULL ELSE CAST(1930 + s_suppkey * 7 % 85 AS INT) END"
DEATH = (
    "CASE WHEN s_suppkey % 41 = 40 THEN 1900 WHEN s_suppkey % 3 = 0 THEN CAST(1975 + s_suppkey * 7 % 45 AS INT) END"
)
PROFESSIONS = _pick(
    "s_suppkey % 6", ["actor,producer", "actress", "director,writer,producer", "writer", "actor,director"]
)
KNOWN_FOR = (
    "CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE concat_ws(',', CAST(s_suppkey * 3 AS STRING),"
    " CAST(s_suppkey * 5 + 1 AS STRING), CASE WHEN s_suppkey % 2 = 0 THEN CAST(9000000000000 + s_suppkey AS STRING) END)"
    " END"
)
BATCH = "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('b', CAST(year(o_orderdate) AS STRING)) END"

# name -> (source table, row filter or None, {column: expression})
PROJECTIONS: dict[str, tuple[str, str | None, dict[str, str]]] = {
    "title_basics_raw": ("orders", None, {
        "tconst": "CASE WHEN o_orderkey % 503 = 7 THEN '' WHEN o_orderkey % 503 = 8 THEN concat(chr(92), 'N')"
                  " WHEN o_orderkey % 503 = 9 THEN NULL ELSE concat('tt', CAST(10000000 + o_orderkey AS STRING)) END",
        "titleType": TITLE_TYPE,
        "primaryTitle": f"CASE WHEN o_orderkey % 97 = 0 THEN {MARK} ELSE {TITLE_NAME} END",
        "originalTitle": f"CASE WHEN o_orderkey % 7 = 0 THEN {MARK} ELSE {TITLE_NAME} END",
        "isAdult": f"CASE WHEN o_orderkey % 17 = 0 THEN '1' WHEN o_orderkey % 23 = 0 THEN {MARK} ELSE '0' END",
        "startYear": _raw(START_YEAR),
        "endYear": _raw(END_YEAR),
        "runtimeMinutes": f"CASE WHEN o_orderkey % 211 = 1 THEN 'Reality' ELSE {_raw(RUNTIME)} END",
        "genres": f"coalesce({GENRES_RAW}, {MARK})",
    }),
    "title_ratings_raw": ("orders", RATED, {
        "tconst": "concat('tt', CAST(10000000 + o_orderkey AS STRING))",
        "averageRating": f"CASE WHEN o_orderkey % 71 = 0 THEN {MARK} WHEN o_orderkey % 73 = 0 THEN '9.95'"
                         f" ELSE CAST({RATING} AS STRING) END",
        "numVotes": f"CAST({VOTES} AS STRING)",
    }),
    "title_crew_raw": ("orders", None, {
        "tconst": "o_orderkey",
        "directors": f"CASE WHEN o_orderkey % 6 = 0 THEN {MARK} WHEN o_orderkey % 6 = 1 THEN CAST(o_custkey AS STRING)"
                     " ELSE concat_ws(',', CAST(o_custkey AS STRING), CAST(o_orderkey % 89 AS STRING)) END",
        "writers": "CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 = 1 THEN NULL"
                   " ELSE concat_ws(',', CAST(o_orderkey % 83 AS STRING), CAST(o_custkey AS STRING),"
                   " CAST(o_orderkey % 83 AS STRING)) END",
    }),
    "title_basics": ("orders", None, {
        "tconst": "o_orderkey",
        "title_type": TITLE_TYPE,
        "primary_title": TITLE_NAME,
        "original_title": f"CASE WHEN o_orderkey % 7 <> 0 THEN {TITLE_NAME} END",
        "is_adult": "o_orderkey % 17 = 0",
        "start_year": START_YEAR,
        "end_year": END_YEAR,
        "runtime_minutes": RUNTIME,
        "genres": GENRES_RAW,
        "is_current": "o_orderkey % 47 <> 11",
        "batch_id": BATCH,
        "ingested_at": "o_orderdate",
    }),
    "title_episode": ("orders", IS_EPISODE, {
        "tconst": "o_orderkey",
        "parent_tconst": PARENT,
        "season_number": SEASON,
        "episode_number": EPISODE,
        "batch_id": BATCH,
        "ingested_at": "o_orderdate",
    }),
    "title_akas": ("lineitem", None, {
        "title_id": "l_orderkey",
        "ordering": "l_linenumber",
        "title": "concat('Aka ', CAST(l_partkey AS STRING))",
        "region": AKA_REGION,
        "language": AKA_LANGUAGE,
        "types": AKA_TYPES,
        "attributes": AKA_ATTRS,
        "is_original_title": f"CASE l_partkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0' ELSE {MARK} END",
        "batch_id": "concat('b', CAST(year(l_shipdate) AS STRING))",
        "ingested_at": "l_shipdate",
    }),
    "title_principal": ("lineitem", None, {
        "tconst": "l_orderkey",
        "ordering": "l_linenumber",
        "nconst": PERSON,
        "category": CATEGORY,
        "job": JOB,
        "characters": CHARACTERS,
        "batch_id": "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE concat('b', CAST(year(l_shipdate) AS STRING)) END",
        "ingested_at": "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_shipdate END",
    }),
    "name_basics": ("supplier", None, {
        "nconst": "s_suppkey",
        "primary_name": PERSON_NAME,
        "birth_year": BIRTH,
        "death_year": DEATH,
        "primary_profession": PROFESSIONS,
        "known_for": KNOWN_FOR,
        "is_current": "s_suppkey % 53 <> 12",
        "batch_id": "concat('b', CAST(s_nationkey AS STRING))",
        "ingested_at": "CAST('2024-01-01 00:00:00' AS TIMESTAMP)",
    }),
    # Gold shaped, light: the columns that the analytics and catalogue queries read.
    "dim_title": ("orders", None, {
        "tconst": "o_orderkey",
        "title_type": TITLE_TYPE,
        "primary_title": TITLE_NAME,
        "original_title": f"CASE WHEN o_orderkey % 7 <> 0 THEN {TITLE_NAME} END",
        "is_adult": "o_orderkey % 17 = 0",
        "start_year": START_YEAR,
        "end_year": END_YEAR,
        "runtime_minutes": RUNTIME,
        "genre_list": GENRES_GOLD,
        "average_rating": RATING,
        "num_votes": VOTES,
        "popularity_segment": f"CASE WHEN NOT ({RATED}) THEN 'unknown' WHEN {VOTES} < 10000 THEN 'low'"
                              f" WHEN {VOTES} < 100000 THEN 'medium' ELSE 'high' END",
        "rating_bucket": f"CASE WHEN NOT ({RATED}) THEN 'unrated' WHEN {PRICE} % 91 < 50 THEN 'average'"
                         f" WHEN {PRICE} % 91 < 70 THEN 'good' ELSE 'excellent' END",
        "parent_tconst": f"CASE WHEN {IS_EPISODE} THEN {PARENT} END",
        "season_number": f"CASE WHEN {IS_EPISODE} THEN {SEASON} END",
        "episode_number": f"CASE WHEN {IS_EPISODE} THEN {EPISODE} END",
        "region_list": REGIONS,
        "language_list": LANGUAGES,
        "aka_count": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 5 + 1 END",
    }),
    "dim_person": ("supplier", None, {
        "nconst": "s_suppkey",
        "primary_name": PERSON_NAME,
        "birth_year": BIRTH,
        "death_year": DEATH,
    }),
    "fact_episode": ("orders", IS_EPISODE, {
        "episode_key": "o_orderkey",
        "series_key": PARENT,
        "season_number": SEASON,
        "episode_number": EPISODE,
    }),
    "fact_performance": ("lineitem", None, {
        "tconst": "l_orderkey",
        "ordering": "l_linenumber",
        "nconst": PERSON,
        "category": CATEGORY,
        "job": JOB,
        "character_name": f"CASE WHEN {ACTING} THEN concat('Role ', CAST(l_partkey % 30 AS STRING)) END",
    }),
    # One logged quality result per event.
    "dq_log": ("events", None, {
        "check_name": "event_type",
        "table_name": "concat('t', CAST(user_id % 5 AS STRING))",
        "metric_name": "CASE WHEN user_id % 2 = 0 THEN 'row_count_variance' ELSE 'null_rate' END",
        "metric_value": "value * 100",
        "passed": "event_type <> 'error'",
        "logged_at": "ts",
        "event_id": "event_id",
    }),
}

SNAPSHOTS = ["2024-01-01", "2024-02-01", "2024-03-01"]
SNAPSHOT_COLUMNS = {
    "tconst": "o_orderkey",
    "snapshot_date": "CAST(snap AS DATE)",
    "average_rating": f"CASE WHEN snap = '2024-03-01' THEN {RATING}"
                      f" WHEN o_orderkey % 59 = 0 THEN NULL ELSE CAST(10 + ({PRICE} + 7) % 91 AS DOUBLE) / 10 END",
    "num_votes": f"CASE WHEN snap = '2024-03-01' THEN {VOTES} ELSE {PRICE} % 1009 END",
    "batch_id": "concat('snap ', snap)",
    "ingested_at": "CAST(snap AS TIMESTAMP)",
}
SOURCES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


class Star:
    """Catalogue-shaped views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def table(self, name: str) -> DataFrame:
        source, keep, columns = PROJECTIONS[name]
        df = self.source(source)
        if keep:
            df = df.filter(keep)
        return df.selectExpr(*[f"{expr} AS {col}" for col, expr in columns.items()])

    def __getattr__(self, name: str) -> DataFrame:
        if name in PROJECTIONS:
            return self.table(name)
        if name in SOURCES:
            return self.source(name)
        raise AttributeError(name)

    @cached_property
    def title_rating(self) -> DataFrame:
        snaps = F.explode(F.array(*[F.lit(s) for s in SNAPSHOTS]))
        df = self.source("orders").filter(RATED).withColumn("snap", snaps)
        return df.selectExpr(*[f"{expr} AS {col}" for col, expr in SNAPSHOT_COLUMNS.items()])


def _cte(source: str, keep: str | None, columns: dict[str, str]) -> str:
    body = ", ".join(f"{expr} AS {col}" for col, expr in columns.items())
    return f"SELECT {body} FROM {source}" + (f" WHERE {keep}" if keep else "")


def oracle_tables() -> dict[str, str]:
    """The bound tables as DuckDB SELECTs, for the check queries."""
    tables = {name: _cte(*spec) for name, spec in PROJECTIONS.items()}
    snaps = ", ".join(f"'{s}'" for s in SNAPSHOTS)
    tables["title_rating"] = _cte(
        f"(SELECT *, unnest([{snaps}]) AS snap FROM orders WHERE {RATED})", None, SNAPSHOT_COLUMNS
    )
    return tables
