"""Data quality, contracts and profiles over the bound tables."""

from pyspark.sql import functions as F

from marquee.functions.scalars import matches
from marquee.operators import quality as dq
from marquee.operators.features import temporal_split
from marquee.operators.joins import recompute_list
from marquee.operators.normalize import normalize_ordered
from marquee.operators.paging import union_all
from marquee.plans import marts
from marquee.session import scratch_path
from marquee.suite.core import query
from marquee.suite.sources import exported

NOW_SQL = "TIMESTAMP '2024-02-15 12:00:00'"


def now():
    """The reference time of all checks."""
    return F.lit("2024-02-15 12:00:00").cast("timestamp_ntz")


def result_sql(check, table, metric, value, threshold, passed=None):
    passed = passed or f"metric_value <= {threshold}"
    return f"""SELECT '{check}' AS check_name, '{table}' AS table_name, '{metric}' AS metric_name, round(metric_value, 6) AS metric_value,
  CAST({threshold} AS DOUBLE) AS threshold, {passed} AS passed FROM (SELECT {value} AS metric_value)"""


def rounded(df):
    return df.withColumn("metric_value", F.round("metric_value", 6))


TITLE_NULLS = "(SELECT count(*) - count(start_year) FROM title_basics) / (SELECT count(*) FROM title_basics)"


@query("i01_null_rate", " UNION ALL ".join([
    result_sql("null_rate_title_basics", "title_basics", "null_rate", TITLE_NULLS, 0.05),
    result_sql("null_rate_title_type", "title_basics", "null_rate", "0.0", 0.0),
]))
def i01(s):
    return rounded(union_all([
        dq.null_rate(s.title_basics, "start_year", 0.05, "null_rate_title_basics", "title_basics"),
        dq.null_rate(s.title_basics, "title_type", 0.0, "null_rate_title_type", "title_basics"),
    ]))


ORPHAN_SHARE = """(SELECT count(*) FILTER (WHERE b.tconst IS NULL) / count(*) FROM title_episode e
  LEFT JOIN title_basics b ON b.tconst = e.parent_tconst AND b.is_current)"""


@query("i02_orphan_rate", result_sql("orphan_title_episode", "title_episode", "orphan_rate", ORPHAN_SHARE, 0.01))
def i02(s):
    parents = marts.current(s.title_basics)
    return rounded(dq.orphan_rate(
        s.title_episode, parents, "parent_tconst", "tconst", 0.01, "orphan_title_episode", "title_episode"))


TITLES = "(SELECT count(*) FROM title_basics)"


@query("i03_row_count_variance", " UNION ALL ".join([
    result_sql("expected", "title_basics", "row_count_variance", f"abs({TITLES} - 16000) / 16000", 0.2),
    result_sql("minimum", "title_basics", "row_count_variance", f"abs({TITLES} - 100000) / 100000", 0.2),
    result_sql("no_base", "title_basics", "row_count_variance", "0.0", 0.2),
]))
def i03(s):
    counted = [("expected", 16_000, 5), ("minimum", 0, 100_000), ("no_base", 0, 0)]
    return rounded(union_all([
        dq.row_count_variance(s.title_basics, 0.2, name, "title_basics", expected, minimum) for name, expected, minimum in counted
    ]))


EVENT_AGE = f"(SELECT date_diff('microsecond', max(ts), {NOW_SQL}) / 3.6e9 FROM events)"


@query("i04_freshness", " UNION ALL ".join([
    result_sql("fresh", "events", "freshness", EVENT_AGE, 48), result_sql("never", "events", "freshness", "999999.0", 48),
]))
def i04(s):
    return rounded(union_all([
        dq.freshness(s.events, "ts", now(), 48, "fresh", "events"),
        dq.freshness(s.events.filter("event_id < 0"), "ts", now(), 48, "never", "events"),
    ]))


@query("i05_alert", " UNION ALL ".join([
    result_sql("loose", "title_basics", "null_rate", "(SELECT count(*) FILTER (WHERE end_year IS NULL) / count(*) FROM title_basics)", 1.0, "false"),
    result_sql("loose_alert", "title_basics", "row_count_deviation", "(SELECT count(*) FILTER (WHERE end_year IS NULL) / count(*) FROM title_basics)", 0.2, "false"),
    result_sql("quiet", "title_basics", "null_rate", TITLE_NULLS, 1.0),
]))
def i05(s):
    rows = union_all([
        dq.null_rate(s.title_basics, "end_year", 1.0, "loose", "title_basics"),
        dq.null_rate(s.title_basics, "start_year", 1.0, "quiet", "title_basics"),
    ])
    return rounded(dq.apply_alert(rows))


CHECKS = [
    dq.Check("null_rate_title_basics", "title_basics", "null_rate", 0.0, options={"column": "primary_title"}),
    dq.Check("null_rate_title_rating", "title_rating", "null_rate", 0.0, options={"column": "average_rating"}),
    dq.Check("orphan_title_episode", "title_episode", "orphan_rate", 0.01, "warn",
             options={"fk_column": "parent_tconst", "pk_table": "title_basics_current", "pk_column": "tconst"}),
    dq.Check("row_count_title_basics", "title_basics", "row_count_variance", 0.5, options={"expected_count": 12_000}),
    dq.Check("row_count_name_basics", "name_basics", "row_count_variance", 0.2, options={"expected_count": 100}),
    dq.Check("row_count_title_episode", "title_episode", "row_count_variance", 0.2, options={"expected_count": 3_000}),
    dq.Check("null_rate_title_episode", "title_episode", "null_rate", 0.0, options={"column": "parent_tconst"}),
]
VARIANCE = f"abs({TITLES} - 12000) / 12000"


@query("i06_run_checks", f"""SELECT *, 'b1' AS batch_id, CASE check_name WHEN 'orphan_title_episode' THEN 'warn' ELSE 'error' END AS severity FROM (
  {result_sql('null_rate_title_basics', 'title_basics', 'null_rate', '0.0', 0)}
  UNION ALL {result_sql('null_rate_title_rating', 'title_rating', 'null_rate', '(SELECT count(*) FILTER (WHERE average_rating IS NULL) / count(*) FROM title_rating)', 0)}
  UNION ALL {result_sql('orphan_title_episode', 'title_episode', 'orphan_rate', ORPHAN_SHARE, 0.01)}
  UNION ALL {result_sql('row_count_title_basics', 'title_basics', 'row_count_variance', VARIANCE, 0.5, f'{VARIANCE} <= 0.2')}
  UNION ALL (FROM ({result_sql('row_count_title_basics_alert', 'title_basics', 'row_count_deviation', VARIANCE, 0.2, 'false')}) WHERE metric_value > 0.2 AND metric_value <= 0.5)
  UNION ALL {result_sql('row_count_name_basics', 'name_basics', 'row_count_variance', '(SELECT abs(count(*) - 100) / 100 FROM name_basics)', 0.2)}
  UNION ALL {result_sql('row_count_title_episode', 'title_episode', 'row_count_variance', '(SELECT abs(count(*) - 3000) / 3000 FROM title_episode)', 0.2)}
  UNION ALL {result_sql('null_rate_title_episode', 'title_episode', 'null_rate', '(SELECT count(*) FILTER (WHERE parent_tconst IS NULL) / count(*) FROM title_episode)', 0)})""")
def i06(s):
    tables = {n: s.table(n) for n in ("title_basics", "title_episode", "name_basics")}
    tables |= {"title_rating": s.title_rating, "title_basics_current": marts.current(s.title_basics)}
    return rounded(dq.run_checks(tables, CHECKS, now(), "b1", log_path=scratch_path(s.spark, "dq-log")))


SLA = {"title_basics": 24 * 9000, "title_akas": 24.0, "title_rating": 24 * 30}


@query("i07_freshness_sla", " UNION ALL ".join(
    result_sql(f"freshness_{t}", t, "freshness", f"(SELECT date_diff('microsecond', max(ingested_at), {NOW_SQL}) / 3.6e9 FROM {t})", h)
    for t, h in SLA.items()))
def i07(s):
    tables = {"title_basics": s.title_basics, "title_akas": s.title_akas, "title_rating": s.title_rating}
    return rounded(dq.freshness_sla(tables, SLA, now()))


@query("i08_expectations", """
SELECT 'row_count' AS check_name, 'title_akas' AS table_name, 'expectation' AS metric_name, CAST(count(*) AS DOUBLE) AS metric_value,
  CAST(1 AS DOUBLE) AS threshold, count(*) >= 1 AS passed FROM title_akas
UNION ALL SELECT 'not_null_region', 'title_akas', 'expectation', round(count(region) / count(*), 6), 0.9, count(region) / count(*) >= 0.9 FROM title_akas
UNION ALL SELECT 'not_null_language', 'title_akas', 'expectation', round(count(language) / count(*), 6), 0.5, count(language) / count(*) >= 0.5 FROM title_akas""")
def i08(s):
    return rounded(dq.expect_not_null(s.title_akas, {"region": 0.9, "language": 0.5}, "title_akas"))


FK_RULES = [
    ("title_episode", "tconst", "titles", "tconst"), ("title_episode", "parent_tconst", "titles", "tconst"),
    ("title_rating", "tconst", "titles", "tconst"), ("title_akas", "title_id", "titles", "tconst"),
    ("title_principal", "tconst", "titles", "tconst"), ("title_principal", "nconst", "people", "nconst"),
    ("name_known_for", "tconst", "titles", "tconst"), ("name_known_for", "nconst", "people", "nconst"),
]
FK_TABLES_SQL = """titles AS (SELECT tconst FROM title_basics WHERE is_current), people AS (SELECT nconst FROM name_basics WHERE is_current),
name_known_for AS (SELECT nconst, CAST(unnest(string_split(known_for, ',')) AS BIGINT) AS tconst FROM name_basics)"""


def fk_sql(rules):
    return f"WITH {FK_TABLES_SQL} " + " UNION ALL ".join(
        f"SELECT '{c}.{fk}' AS fk_check, count(*) AS orphan_count FROM {c} WHERE {fk} IS NULL OR {fk} NOT IN (SELECT {pk} FROM {p})"
        for c, fk, p, pk in rules
    )


def fk_tables(s):
    known = normalize_ordered(s.name_basics, ["nconst"], "known_for", "tconst")
    tables = {n: s.table(n) for n in ("title_episode", "title_akas", "title_principal")}
    return tables | {
        "title_rating": s.title_rating, "titles": marts.current(s.title_basics), "people": marts.current(s.name_basics),
        "name_known_for": known.withColumn("tconst", known.tconst.cast("bigint")),
    }


@query("i09_fk_suite", fk_sql(FK_RULES))
def i09(s):
    return dq.fk_suite(fk_tables(s), FK_RULES)


@query("i10_validate_contract", """
SELECT 'missing_column' AS rule, 'budget' AS subject, CAST(1 AS BIGINT) AS violations, false AS passed
UNION ALL SELECT 'minimum_rows', 'title_episode', greatest(1000000 - count(*), 0), count(*) >= 1000000 FROM title_episode
UNION ALL SELECT 'null', 'tconst', 0, true
UNION ALL SELECT 'null', 'season_number', count(*) - count(season_number), count(*) = count(season_number) FROM title_episode
UNION ALL SELECT 'orphan', 'parent_tconst', count(*), count(*) = 0 FROM title_episode e
  WHERE e.parent_tconst IS NOT NULL AND e.parent_tconst NOT IN (SELECT tconst FROM title_basics WHERE is_current)""")
def i10(s):
    contract = {"tconst": False, "season_number": False, "episode_number": True, "budget": True}
    parents = {"parent_tconst": (marts.current(s.title_basics), "tconst")}
    return dq.validate_contract(s.title_episode, "title_episode", contract, 1_000_000, parents)


@query("i11_unique_not_null", " UNION ALL ".join([
    result_sql("unique_tconst", "dim_title", "repeated_values", "0.0", 0),
    result_sql("unique_primary_name", "dim_person", "repeated_values",
               "CAST((SELECT count(*) FROM (SELECT primary_name FROM dim_person GROUP BY ALL HAVING count(*) > 1)) AS DOUBLE)", 0),
    result_sql("not_null_primary_title", "dim_title", "null_rows", "0.0", 0),
    result_sql("not_null_birth_year", "dim_person", "null_rows", "CAST((SELECT count(*) - count(birth_year) FROM dim_person) AS DOUBLE)", 0),
]))
def i11(s):
    return union_all([
        dq.unique(s.dim_title, "tconst", "dim_title"), dq.unique(s.dim_person, "primary_name", "dim_person"),
        dq.not_null(s.dim_title, "primary_title", "dim_title"), dq.not_null(s.dim_person, "birth_year", "dim_person"),
    ])


RANGES = [
    ("start_year", 1874, 2030, "warn"), ("average_rating", 0.0, 10.0, "error"), ("num_votes", 0, None, "error"),
    ("runtime_minutes", 1, 1000, "warn"),
]


@query("i12_accepted_range", " UNION ALL ".join(
    "SELECT *, '{sev}' AS severity FROM ({sql})".format(sev=severity, sql=result_sql(
        f"range_{c}", "dim_title", "rows_outside",
        f"CAST((SELECT count(*) FROM dim_title WHERE {c} < {low}{f' OR {c} > {high}' if high is not None else ''}) AS DOUBLE)", 0))
    for c, low, high, severity in RANGES))
def i12(s):
    return union_all([dq.accepted_range(s.dim_title, c, "dim_title", low, high, sev) for c, low, high, sev in RANGES])


@query("i13_unique_combo", result_sql(
    "unique_tconst_ordering", "title_principal", "duplicates",
    "CAST((SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM title_principal GROUP BY tconst, ordering)) AS DOUBLE)", 0))
def i13(s):
    return dq.unique_combo(s.title_principal, ["tconst", "ordering"], "title_principal")


SUMMARY_RULES = [FK_RULES[1], FK_RULES[2], FK_RULES[6]]


@query("i14_fk_summary", fk_sql(SUMMARY_RULES))
def i14(s):
    return dq.fk_suite(fk_tables(s), SUMMARY_RULES)


@query("i15_variance_vs_log", """
WITH l AS (SELECT metric_value AS p FROM dq_log WHERE check_name = 'view' AND metric_name = 'row_count_variance' AND passed
  ORDER BY logged_at DESC, metric_value DESC LIMIT 1), c AS (SELECT count(*) AS n FROM title_basics WHERE is_current)
SELECT n AS current_row_count, p AS previous_row_count, round(abs(n - p) / p, 6) AS deviation_ratio FROM l, c WHERE p > 0 AND abs(n - p) / p > 0.2""")
def i15(s):
    found = dq.variance_vs_log(marts.current(s.title_basics), s.dq_log, "view", "row_count_variance")
    return found.withColumn("deviation_ratio", F.round("deviation_ratio", 6))


LAYERS = {
    "title_basics/dim_title": ("title_basics", "dim_title"), "title_ratings/title_rating": ("title_ratings_raw", "title_rating"),
    "title_basics/current": ("title_basics", "title_basics_current"),
}


@query("i16_layer_ratios", "SELECT pair, before, after, round(after / before, 6) AS ratio, after / before BETWEEN 0.95 AND 1.05 AS ok FROM ("
       + " UNION ALL ".join(
           f"SELECT '{n}' AS pair, (SELECT count(*) FROM {a}) AS before, (SELECT count(*) FROM {b.replace('title_basics_current', 'title_basics WHERE is_current')}) AS after"
           for n, (a, b) in LAYERS.items()) + ")")
def i16(s):
    tables = {n: s.table(n) for n in ("title_basics", "dim_title", "title_ratings_raw")}
    tables |= {"title_rating": s.title_rating, "title_basics_current": marts.current(s.title_basics)}
    ratios = dq.layer_ratios({n: (tables[a], tables[b]) for n, (a, b) in LAYERS.items()})
    return ratios.withColumn("ratio", F.round("ratio", 6))


@query("i17_compare_counts", """
WITH a AS (SELECT count(*) AS r, count(DISTINCT tconst) AS k FROM title_basics), b AS (SELECT count(*) AS r, count(DISTINCT tconst) AS k FROM fact_performance)
SELECT a.r AS left_rows, a.k AS left_keys, b.r AS right_rows, b.k AS right_keys, a.r = b.r AS rows_match, a.k = b.k AS keys_match FROM a, b""")
def i17(s):
    return dq.compare_counts(s.title_basics, s.fact_performance, "tconst")


RAW_RATING = """(SELECT CAST(substr(tconst, 3) AS BIGINT) - 10000000 AS tconst, try_cast("averageRating" AS DOUBLE) AS average_rating FROM title_ratings_raw)"""


@query("i18_value_mismatch", f"""
SELECT count(*) AS compared, count(*) FILTER (WHERE abs(r.average_rating - d.average_rating) > 0.01) AS mismatched
FROM {RAW_RATING} r JOIN dim_title d USING (tconst) WHERE r.average_rating IS NOT NULL AND d.average_rating IS NOT NULL""")
def i18(s):
    raw = s.title_ratings_raw.select(
        (F.substr("tconst", F.lit(3)).cast("bigint") - 10_000_000).alias("tconst"), F.col("averageRating").try_cast("double").alias("average_rating")
    )
    return dq.value_mismatch(raw, s.dim_title, "tconst", "average_rating")


@query("i19_missing_keys", "SELECT DISTINCT nconst FROM fact_performance WHERE nconst NOT IN (SELECT nconst FROM dim_person)")
def i19(s):
    return dq.missing_keys(s.fact_performance, s.dim_person, "nconst")


# The accepted title types.
TITLE_TYPES = ["movie", "short", "tvEpisode", "tvMiniSeries", "tvMovie", "tvSeries", "tvShort", "tvSpecial", "video", "videoGame"]


@query("i20_validity_rules", f"""
SELECT 'title_basics_raw' AS table_name, 'id_format' AS rule, count(*) FILTER (WHERE NOT regexp_matches(tconst, '^tt[0-9]+$')) AS violations FROM title_basics_raw
UNION ALL SELECT 'title_basics_raw', 'flag_domain', count(*) FILTER (WHERE "isAdult" NOT IN ('0', '1')) FROM title_basics_raw
UNION ALL SELECT 'dim_title', 'runtime_not_positive', count(*) FILTER (WHERE runtime_minutes <= 0) FROM dim_title
UNION ALL SELECT 'dim_title', 'runtime_extreme', count(*) FILTER (WHERE runtime_minutes > 1000) FROM dim_title
UNION ALL SELECT 'dim_title', 'rating_bounds', count(*) FILTER (WHERE average_rating NOT BETWEEN 1 AND 10) FROM dim_title
UNION ALL SELECT 'dim_title', 'type_domain', count(*) FILTER (WHERE title_type NOT IN ({', '.join(f"'{t}'" for t in TITLE_TYPES)})) FROM dim_title
UNION ALL SELECT 'dim_title', 'ends_before_start', count(*) FILTER (WHERE end_year < start_year) FROM dim_title
UNION ALL SELECT 'dim_title', 'start_year_range', count(*) FILTER (WHERE start_year NOT BETWEEN 1874 AND 2115) FROM dim_title
UNION ALL SELECT 'fact_episode', 'negative_season', count(*) FILTER (WHERE season_number < 0) FROM fact_episode
UNION ALL SELECT 'fact_episode', 'negative_episode', count(*) FILTER (WHERE episode_number < 0) FROM fact_episode
UNION ALL SELECT 'dim_person', 'birth_year_range', count(*) FILTER (WHERE birth_year NOT BETWEEN 1800 AND 2026) FROM dim_person
UNION ALL SELECT 'dim_person', 'dies_before_birth', count(*) FILTER (WHERE death_year < birth_year) FROM dim_person""")
def i20(s):
    c = F.col
    return union_all([
        dq.validity_rules(s.title_basics_raw, "title_basics_raw", {
            "id_format": ~matches("tconst", "^tt[0-9]+$"), "flag_domain": ~c("isAdult").isin("0", "1"),
        }),
        dq.validity_rules(s.dim_title, "dim_title", {
            "runtime_not_positive": c("runtime_minutes") <= 0, "runtime_extreme": c("runtime_minutes") > 1000,
            "rating_bounds": ~c("average_rating").between(1, 10), "type_domain": ~c("title_type").isin(TITLE_TYPES),
            "ends_before_start": c("end_year") < c("start_year"), "start_year_range": ~c("start_year").between(1874, 2115),
        }),
        dq.validity_rules(s.fact_episode, "fact_episode", {
            "negative_season": c("season_number") < 0, "negative_episode": c("episode_number") < 0,
        }),
        dq.validity_rules(s.dim_person, "dim_person", {
            "birth_year_range": ~c("birth_year").between(1800, 2026), "dies_before_birth": c("death_year") < c("birth_year"),
        }),
    ])


@query("i21_bad_parent_type", """
SELECT count(DISTINCT series_key) AS bad_series FROM fact_episode e LEFT JOIN dim_title d ON d.tconst = e.series_key
WHERE d.tconst IS NULL OR d.title_type NOT LIKE '%tv%'""")
def i21(s):
    return dq.bad_parent_type(s.fact_episode, s.dim_title)


@query("i22_list_consistency", """
WITH calc AS (SELECT f.tconst, string_agg(p.primary_name, ', ' ORDER BY f.ordering, f.nconst) AS names FROM fact_performance f
  JOIN dim_person p USING (nconst) WHERE category = 'director' GROUP BY f.tconst),
stored AS (SELECT tconst, CASE WHEN tconst % 40 = 0 THEN names || ' (edited)' ELSE names END AS names FROM calc)
SELECT count(*) AS compared, count(*) FILTER (WHERE s.names <> c.names) AS mismatched,
  round(100 * (1 - count(*) FILTER (WHERE s.names <> c.names) / count(*)), 6) AS match_rate,
  100 * (1 - count(*) FILTER (WHERE s.names <> c.names) / count(*)) > 90 AS ok FROM stored s LEFT JOIN calc c USING (tconst)""")
def i22(s):
    """A stored list in which one title of forty was edited."""
    right = recompute_list(s.fact_performance, s.dim_person, "director", "director_names")
    edited = F.when(F.col("tconst") % 40 == 0, F.concat("director_names", F.lit(" (edited)"))).otherwise(F.col("director_names"))
    stored = right.withColumn("director_names", edited)
    found = dq.list_consistency(stored, s.fact_performance, s.dim_person, "director", "director_names")
    return found.withColumn("match_rate", F.round("match_rate", 6))


@query("i23_manifest_drift", """
WITH d AS (SELECT 'dim_title' AS t, count(*) AS actual, count(*) FILTER (WHERE title_type <> 'movie' OR runtime_minutes > 0) AS declared FROM dim_title
  UNION ALL SELECT 'dim_person', count(*), count(*) FROM dim_person UNION ALL SELECT 'fact_episode', count(*), count(*) FROM fact_episode
  UNION ALL SELECT 'fact_performance', count(*), count(*) FROM fact_performance)
SELECT t AS table_name, declared, actual, round(abs(actual - declared) / declared, 6) AS drift, abs(actual - declared) / declared <= 0.01 AS ok FROM d""")
def i23(s):
    """The export manifest against the unfiltered marts."""
    _, manifest = exported(s)
    counts = dq.count_tables({n: s.table(n) for n in ("dim_title", "dim_person", "fact_episode", "fact_performance")})
    return dq.manifest_drift(manifest, counts).withColumn("drift", F.round("drift", 6))


PROFILED = ["start_year", "end_year", "runtime_minutes", "genre_list", "average_rating", "num_votes", "region_list", "aka_count", "title_type"]


@query("i24_null_profile", "SELECT 'dim_title' AS table_name, column_name, round(null_share, 6) AS null_share, null_share > 0.05 AS high FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS column_name, 1 - count({c}) / count(*) AS null_share FROM dim_title" for c in PROFILED) + ")")
def i24(s):
    return dq.null_profile(s.dim_title.select(*PROFILED), "dim_title").withColumn("null_share", F.round("null_share", 6))


MINIMUMS = {"dim_title": 1_000_000, "dim_person": 50, "fact_performance": 5_000}


@query("i25_min_volume", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n, CAST({m} AS BIGINT) AS minimum, count(*) >= {m} AS ok FROM {t}" for t, m in MINIMUMS.items()))
def i25(s):
    return dq.min_volume(dq.count_tables({n: s.table(n) for n in MINIMUMS}), MINIMUMS)


@query("i26_recency", "SELECT max(start_year) AS max_year, max(start_year) >= 2024 AS ok FROM dim_title")
def i26(s):
    return dq.recency(s.dim_title, "start_year", 2026)


KEY_GENRES = ["Drama", "Comedy", "Documentary", "Action", "Horror"]


@query("i27_presence", " UNION ALL ".join(
    f"SELECT '{g}' AS item, count(*) AS n FROM dim_title WHERE list_contains(string_split(genre_list, ', '), '{g}')" for g in KEY_GENRES))
def i27(s):
    return dq.presence(s.dim_title, "genre_list", KEY_GENRES)


@query("i28_profile", """
SELECT 'supplier' AS table_name, (SELECT count(*) FROM supplier) AS rows, * FROM (
SELECT 's_suppkey' AS column_name, 'bigint' AS data_type, count(s_suppkey) AS non_null, CAST(min(s_suppkey) AS VARCHAR) AS "min", CAST(max(s_suppkey) AS VARCHAR) AS "max", round(avg(s_suppkey), 6) AS mean FROM supplier
UNION ALL SELECT 's_name', 'string', count(s_name), min(s_name), max(s_name), NULL FROM supplier
UNION ALL SELECT 's_nationkey', 'int', count(s_nationkey), CAST(min(s_nationkey) AS VARCHAR), CAST(max(s_nationkey) AS VARCHAR), round(avg(s_nationkey), 6) FROM supplier
UNION ALL SELECT 's_acctbal', 'double', count(s_acctbal), CAST(min(s_acctbal) AS VARCHAR), CAST(max(s_acctbal) AS VARCHAR), round(avg(s_acctbal), 6) FROM supplier)""")
def i28(s):
    return dq.profile(s.supplier, "supplier").withColumn("mean", F.round("mean", 6))


@query("i29_dq_report", """
SELECT table_name, count(*) AS checks, count(*) FILTER (WHERE NOT passed) AS failures, round(100.0 * count(*) FILTER (WHERE passed) / count(*), 6) AS pass_rate
FROM dq_log WHERE logged_at > TIMESTAMP '2024-04-10 00:00:00' - INTERVAL 90 DAY GROUP BY table_name""")
def i29(s):
    report = dq.dq_report(s.dq_log, F.lit("2024-04-10 00:00:00").cast("timestamp_ntz"))
    return report.withColumn("pass_rate", F.round("pass_rate", 6))


@query("i30_check_split", """
WITH t AS (SELECT tconst, start_year AS y, CASE WHEN tconst % 500 = 3 THEN 'holdout' WHEN tconst % 400 = 7 THEN 'train' WHEN start_year <= 2014 THEN 'train'
  WHEN start_year <= 2018 THEN 'val' WHEN start_year > 2018 THEN 'test' END AS s FROM dim_title)
SELECT 'unknown_label' AS rule, count(*) FILTER (WHERE s = 'holdout') AS violations FROM t
UNION ALL SELECT 'null_label', count(*) FILTER (WHERE s IS NULL AND y IS NOT NULL) FROM t
UNION ALL SELECT 'label_without_year', count(*) FILTER (WHERE s IS NOT NULL AND y IS NULL) FROM t
UNION ALL SELECT 'train_too_late', count(*) FILTER (WHERE s = 'train' AND y > 2014) FROM t
UNION ALL SELECT 'val_outside', count(*) FILTER (WHERE s = 'val' AND y NOT BETWEEN 2015 AND 2018) FROM t
UNION ALL SELECT 'test_too_early', count(*) FILTER (WHERE s = 'test' AND y < 2019) FROM t
UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT tconst) FROM t
UNION ALL SELECT 'empty_' || n, CASE WHEN n IN (SELECT s FROM t WHERE s IS NOT NULL) THEN 0 ELSE 1 END FROM (VALUES ('train'), ('val'), ('test')) v(n)""")
def i30(s):
    """A split with some labels spoiled."""
    k = F.col("tconst")
    label = F.when(k % 500 == 3, "holdout").when(k % 400 == 7, "train").otherwise(temporal_split("start_year"))
    return dq.check_split(s.dim_title.select("tconst", "start_year", label.alias("split")), "tconst", "start_year", "split")
