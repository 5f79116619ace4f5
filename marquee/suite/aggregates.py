"""Aggregations and windows."""

from pyspark.sql import functions as F

from marquee.functions.scalars import split_list
from marquee.operators import aggregates as ag
from marquee.operators import joins, ordering, windows
from marquee.operators.features import dated_credits
from marquee.suite.core import query

CATEGORIES = [
    "actor", "actress", "director", "writer", "producer", "composer", "editor", "cinematographer", "self",
    "archive_footage", "archive_sound",
]


@query("e01_group_stats", """
SELECT title_type, start_year, count(*) AS n, round(avg(average_rating), 8) AS mean_rating, min(num_votes) AS low, max(num_votes) AS high,
  CAST(sum(num_votes) AS BIGINT) AS votes FROM dim_title GROUP BY ALL""")
def e01(s):
    return ag.group_stats(s.dim_title, ["title_type", "start_year"], {
        "n": F.count("*"), "mean_rating": F.round(F.avg("average_rating"), 8), "low": F.min("num_votes"),
        "high": F.max("num_votes"), "votes": F.sum("num_votes"),
    })


@query("e02_count_by_category", "SELECT tconst, "
       + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {c}_count" for c in CATEGORIES)
       + " FROM fact_performance GROUP BY tconst")
def e02(s):
    return ag.count_by_category(s.fact_performance, "tconst", "category", CATEGORIES)


@query("e03_count_distinct", "SELECT category, count(DISTINCT nconst) AS people FROM fact_performance GROUP BY category")
def e03(s):
    return ag.count_distinct(s.fact_performance, ["category"], "nconst", "people")


@query("e04_ordered_concat", """
SELECT f.tconst, string_agg(p.primary_name, ', ' ORDER BY f.ordering, f.nconst, f.category) AS people FROM fact_performance f
JOIN dim_person p ON p.nconst = f.nconst GROUP BY f.tconst""")
def e04(s):
    named = s.fact_performance.join(s.dim_person, "nconst")
    return joins.ordered_concat(named, ["tconst"], "primary_name", ["ordering", "nconst", "category"], "people")


@query("e05_concat_values", """
SELECT title_id, string_agg(trim(region), ', ' ORDER BY trim(region)) AS regions FROM title_akas WHERE region IS NOT NULL GROUP BY title_id""")
def e05(s):
    trimmed = s.title_akas.select("title_id", F.trim("region").alias("region"))
    return joins.ordered_concat(trimmed, ["title_id"], "region", ["region"], "regions")


@query("e06_aka_summary", """
WITH d AS (SELECT title_id, region, language, count(*) AS n FROM title_akas GROUP BY ALL)
SELECT title_id, string_agg(region, ', ' ORDER BY region, coalesce(language, '')) AS region_list,
  string_agg(language, ', ' ORDER BY region, coalesce(language, '')) FILTER (WHERE region IS NOT NULL) AS language_list,
  nullif(count(region), 0) AS aka_count, CAST(sum(n) AS BIGINT) AS aka_rows FROM d GROUP BY title_id""")
def e06(s):
    return ag.aka_summary(s.title_akas)


@query("e07_having", """
SELECT nconst, count(*) AS n, round(avg(average_rating), 8) AS mean_rating FROM fact_performance f JOIN dim_title d USING (tconst)
WHERE average_rating IS NOT NULL AND category = 'director' GROUP BY nconst HAVING count(*) >= 80""")
def e07(s):
    rated = s.dim_title.filter("average_rating IS NOT NULL").select("tconst", "average_rating")
    directed = s.fact_performance.filter("category = 'director'").join(rated, "tconst")
    aggs = {"n": F.count("*"), "mean_rating": F.round(F.avg("average_rating"), 8)}
    return ag.group_stats(directed, ["nconst"], aggs, having=F.col("n") >= 80)


@query("e08_arg_max", """
SELECT nconst, category, (array_agg(start_year ORDER BY average_rating DESC, tconst))[1] AS peak_year FROM fact_performance
JOIN dim_title USING (tconst) WHERE start_year IS NOT NULL AND average_rating IS NOT NULL GROUP BY ALL""")
def e08(s):
    rated = s.dim_title.filter("start_year IS NOT NULL AND average_rating IS NOT NULL")
    rated = rated.select("tconst", "start_year", "average_rating")
    credits = s.fact_performance.select("tconst", "nconst", "category").join(rated, "tconst")
    return ag.arg_max(credits, ["nconst", "category"], "start_year", "average_rating", "peak_year", tie="tconst")


@query("e09_numeric_summary", """
SELECT quantile_cont(num_votes, 0.25) AS q1, median(num_votes) AS q2, quantile_cont(num_votes, 0.75) AS q3, count(num_votes) AS n,
  round(corr(num_votes, average_rating), 6) AS corr FROM dim_title""")
def e09(s):
    quantiles = ordering.exact_quantiles(s.dim_title, "num_votes", [0.25, 0.5, 0.75])
    corr = s.dim_title.agg(F.round(F.corr("num_votes", "average_rating"), 6).alias("corr"))
    return joins.cross_scalar(quantiles, corr).select(
        F.col("q0").alias("q1"), F.col("q1").alias("q2"), F.col("q2").alias("q3"), "n", "corr"
    )


@query("e09_quantiles_by_type", """
SELECT title_type, round(quantile_cont(num_votes, 0.1), 6) AS low, round(quantile_cont(num_votes, 0.5), 6) AS mid,
  round(quantile_cont(num_votes, 0.9), 6) AS high
FROM dim_title GROUP BY title_type""")
def e09_by_type(s):
    found = ordering.exact_quantiles(s.dim_title, "num_votes", [0.1, 0.5, 0.9], keys=["title_type"])
    names = {"q0": "low", "q1": "mid", "q2": "high"}
    return found.select("title_type", *[F.round(q, 6).alias(name) for q, name in names.items()])


@query("e10_trim_quantiles", """
WITH m AS (SELECT tconst, runtime_minutes FROM dim_title WHERE title_type = 'movie' AND runtime_minutes > 0)
SELECT * FROM m WHERE runtime_minutes BETWEEN (SELECT quantile_cont(runtime_minutes, 0.0003) FROM m)
  AND (SELECT quantile_cont(runtime_minutes, 0.99) FROM m)""")
def e10(s):
    movies = s.dim_title.filter("title_type = 'movie' AND runtime_minutes > 0").select("tconst", "runtime_minutes")
    return ag.trim_quantiles(movies, "runtime_minutes", 0.0003, 0.99)


TYPES = ["movie", "tvSeries", "tvMiniSeries", "short", "video", "tvEpisode"]


@query("e11_pivot_matrix", "SELECT start_year, "
       + ", ".join(f"count(*) FILTER (WHERE title_type = '{t}') AS \"{t}\"" for t in TYPES)
       + " FROM dim_title WHERE start_year IS NOT NULL GROUP BY start_year")
def e11(s):
    dated = s.dim_title.filter("start_year IS NOT NULL")
    return ag.pivot_matrix(dated, "start_year", "title_type", F.count(F.lit(1)), TYPES)


@query("e12_pivot_roles", """
WITH c AS (SELECT tconst, category, count(*) AS n, max(ordering) AS last FROM fact_performance GROUP BY ALL)
SELECT tconst, max(CASE category WHEN 'director' THEN n END) AS dir_n, max(CASE category WHEN 'director' THEN last END) AS dir_last,
  max(CASE category WHEN 'writer' THEN n END) AS wri_n, max(CASE category WHEN 'writer' THEN last END) AS wri_last FROM c GROUP BY tconst""")
def e12(s):
    counted = s.fact_performance.groupBy("tconst", "category").agg(F.count("*").alias("n"), F.max("ordering").alias("last"))
    return ag.pivot_roles(counted, "tconst", "category", {"director": "dir", "writer": "wri"}, {"n": "n", "last": "last"})


@query("e13_proportion", """
WITH c AS (SELECT start_year, title_type, count(*) AS cnt FROM dim_title WHERE start_year IS NOT NULL GROUP BY ALL)
SELECT *, round(cnt / sum(cnt) OVER (PARTITION BY start_year), 6) AS proportion FROM c""")
def e13(s):
    shares = ag.proportion(s.dim_title.filter("start_year IS NOT NULL"), ["start_year"], ["title_type"])
    return shares.withColumn("proportion", F.round("proportion", 6))


def careers(s, roles):
    credits = dated_credits(s.fact_performance, s.dim_title, roles)
    spans = credits.groupBy("nconst", "category").agg((F.max("start_year") - F.min("start_year")).alias("length"))
    return spans


SURVIVAL_SQL = """
WITH c AS (SELECT category, max(start_year) - min(start_year) AS length FROM fact_performance JOIN dim_title USING (tconst)
  WHERE start_year IS NOT NULL AND category IN ('actor', 'director') GROUP BY nconst, category)
SELECT category, CAST(t AS INTEGER) AS t, round(avg(CASE WHEN length > t THEN 1.0 ELSE 0.0 END), 6) AS survival FROM c, range(1, 61) r(t) GROUP BY ALL"""


@query("e14_survival_curve", SURVIVAL_SQL)
def e14(s):
    curve = ag.survival_curve(careers(s, ["actor", "director"]), "category", "length", 60)
    return curve.withColumn("survival", F.round("survival", 6))


@query("e15_duplicate_keys", """
SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT tconst, ordering FROM fact_performance)) AS BIGINT) AS duplicates
FROM fact_performance""")
def e15(s):
    return ag.duplicate_keys(s.fact_performance, ["tconst", "ordering"])


def histogram_sql(table, columns, bins=20, edges=None):
    """Histograms from first principles: bin of each value, counts over a full grid, smoothed density."""
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {table} WHERE {c} IS NOT NULL" for c in columns)
    edge_parts = parts if edges is None else " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM {edges} WHERE {c} IS NOT NULL" for c in columns
    )
    return f"""
SELECT feature, bin, n, d / sum(d) OVER (PARTITION BY feature) AS prob FROM (
  SELECT g.feature, g.bin, coalesce(c.n, 0) AS n,
    coalesce(c.n, 0) / (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.feature) * (g.hi - g.lo) / {bins}) + 1e-10 AS d
  FROM (SELECT feature, lo, hi, CAST(unnest(range(1, {bins} + 1)) AS INTEGER) AS bin
        FROM (SELECT feature, min(v) AS lo, max(v) AS hi FROM ({edge_parts}) GROUP BY feature)) g
  LEFT JOIN (SELECT feature, CASE WHEN v = hi THEN {bins} ELSE CAST(floor((v - lo) / (hi - lo) * {bins}) AS INTEGER) + 1 END AS bin, count(*) AS n
             FROM ({parts}) JOIN (SELECT feature, min(v) AS lo, max(v) AS hi FROM ({edge_parts}) GROUP BY feature) USING (feature)
             WHERE v BETWEEN lo AND hi GROUP BY ALL) c USING (feature, bin))"""


HIST_COLUMNS = ["start_year", "runtime_minutes", "average_rating", "num_votes"]


@query("e16_histogram", f"SELECT feature, bin, n, round(prob, 8) AS prob FROM ({histogram_sql('dim_title', HIST_COLUMNS)})")
def e16(s):
    return ag.histograms(s.dim_title, HIST_COLUMNS).withColumn("prob", F.round("prob", 8))


@query("e17_top_categories", """
WITH g AS (SELECT unnest(string_split(genre_list, ', ')) AS genre, num_votes FROM dim_title),
t AS (SELECT genre FROM g GROUP BY genre ORDER BY count(*) DESC, genre LIMIT 5)
SELECT genre, count(*) AS titles, CAST(sum(num_votes) AS BIGINT) AS votes FROM g WHERE genre IN (FROM t) GROUP BY genre""")
def e17(s):
    genres = s.dim_title.select(F.explode(split_list("genre_list")).alias("genre"), "num_votes")
    top = ag.restrict_to_top(genres, "genre", 5)
    return top.groupBy("genre").agg(F.count("*").alias("titles"), F.sum("num_votes").alias("votes"))


# Windows

PAIRS = """p AS (SELECT DISTINCT a.tconst, a.nconst AS nconst_a, b.nconst AS nconst_b FROM fact_performance a JOIN fact_performance b
  ON a.tconst = b.tconst AND a.nconst < b.nconst WHERE a.category = 'actor' AND b.category = 'actor')"""


def actor_pairs(s):
    acting = s.fact_performance.filter("category = 'actor'").select("tconst", "nconst").distinct()
    return joins.pairs(acting, "tconst", "nconst")


@query("f01_collaboration_rank", f"""
WITH {PAIRS} SELECT p.*, d.num_votes,
  row_number() OVER (PARTITION BY nconst_a, nconst_b ORDER BY num_votes DESC NULLS LAST, p.tconst) AS collaboration_rank
FROM p JOIN dim_title d ON d.tconst = p.tconst""")
def f01(s):
    voted = actor_pairs(s).join(s.dim_title.select("tconst", "num_votes"), "tconst")
    return windows.collaboration_rank(voted, ["nconst_a", "nconst_b"], "num_votes", "tconst")


@query("f02_total_collaborations", f"""
WITH {PAIRS} SELECT *, count(*) OVER (PARTITION BY nconst_a, nconst_b) AS total_collaborations FROM p""")
def f02(s):
    return windows.partition_total(actor_pairs(s), ["nconst_a", "nconst_b"], "total_collaborations")


@query("f03_first_per_name", """
SELECT primary_title, tconst, num_votes FROM dim_title
QUALIFY row_number() OVER (PARTITION BY primary_title ORDER BY num_votes DESC NULLS LAST, tconst) = 1""")
def f03(s):
    titles = s.dim_title.select("primary_title", "tconst", "num_votes")
    return windows.first_per(titles, ["primary_title"], [F.desc_nulls_last("num_votes"), F.asc("tconst")])


CREDITS = """c AS (SELECT f.tconst, f.nconst, f.category, d.start_year FROM fact_performance f JOIN dim_title d USING (tconst)
  WHERE d.start_year IS NOT NULL AND f.category IN ('director', 'writer'))"""
ROLES = ["director", "writer"]
BY = ["nconst", "category"]


def crew(s):
    return dated_credits(s.fact_performance, s.dim_title, ROLES)


@query("f04_debut_year", f"""
WITH {CREDITS} SELECT tconst, nconst, category, start_year, min(start_year) OVER (PARTITION BY nconst, category) AS debut_year FROM c""")
def f04(s):
    return windows.debut_year(crew(s), BY, "start_year")


@query("f05_cumulative_credits", f"""
WITH {CREDITS} SELECT nconst, category, start_year, count(*) OVER (PARTITION BY nconst, category ORDER BY start_year
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_credits FROM c""")
def f05(s):
    return windows.cumulative_credits(crew(s), BY, "start_year")


@query("f06_recent_credits", f"""
WITH {CREDITS} SELECT nconst, category, start_year, count(*) OVER (PARTITION BY nconst, category ORDER BY start_year
  RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent_credits FROM c""")
def f06(s):
    return windows.recent_credits(crew(s), BY, "start_year", 5)


@query("f07_top_k_per_user", """
SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM orders QUALIFY rank <= 5""")
def f07(s):
    orders = s.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.top_k(orders, "o_custkey", "o_totalprice", "o_orderkey", 5).withColumn("rank", F.col("rank").cast("long"))
