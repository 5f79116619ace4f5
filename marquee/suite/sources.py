"""Sources and sinks. Files go to fresh folders under the shared directory."""

from pyspark.sql import functions as F

from marquee.functions.scalars import NULL_MARK
from marquee.operators.paging import union_all
from marquee.session import scratch_path
from marquee.sources import files, jdbc, sampling
from marquee.suite.core import query



def raw_people(s):
    text = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)).alias(n) for c, n in (
        ("nconst", "nconst"), ("primary_name", "primaryName"), ("birth_year", "birthYear"), ("death_year", "deathYear"),
        ("primary_profession", "primaryProfession"), ("known_for", "knownForTitles"))]
    return s.name_basics.select(*text)


def raw_titles(s):
    return s.title_basics_raw.filter("tconst IS NOT NULL AND tconst <> ''")


def titles_file(s):
    path = scratch_path(s.spark, "raw-titles")
    files.write_raw_tsv(raw_titles(s), path)
    return path


RAW_TITLES = "SELECT * FROM title_basics_raw WHERE tconst <> ''"


@query("a01_read_raw_tsv", RAW_TITLES)
def a01(s):
    return files.read_raw_tsv(s.spark, titles_file(s), files.raw_schema("title.basics"), partitions=8)


@query("a02_validate_source", """
SELECT l_orderkey % 13 <> 4 AS good, count(*) AS n FROM lineitem GROUP BY ALL""")
def a02(s):
    """Lines of three columns, of which some lost the last one."""
    path = scratch_path(s.spark, "lines")
    short = F.concat_ws("\t", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    full = F.concat_ws("\t", short, F.col("l_suppkey").cast("string"))
    s.lineitem.select(F.when(F.col("l_orderkey") % 13 == 4, short).otherwise(full).alias("value")).write.text(path)
    good, bad, _ = files.validate_source(s.spark, path, 3)
    sides = good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False)))
    return sides.groupBy("good").agg(F.count("*").alias("n"))


@query("a03_file_checksums")
def a03(s):
    sums = files.file_checksums(s.spark, f"{s.sf_dir}/*.parquet")
    return sums.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", "checksum")


@query("a04_lineage", """
SELECT o_orderkey, 'orders.parquet' AS _source_file, 'orders' AS _source_table, 'b1' AS _batch_id,
  TIMESTAMP '2024-01-31' AS _ingested_at, (SELECT count(*) FROM orders) AS _row_count, CAST(NULL AS VARCHAR) AS _checksum FROM orders""")
def a04(s):
    stamp = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return files.with_lineage(s.orders.select("o_orderkey"), "orders.parquet", "orders", "b1", stamp)


@query("a05_write_bronze", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def a05(s):
    path = scratch_path(s.spark, "bronze")
    files.write_bronze(s.orders, path)
    if files.write_bronze(s.orders.filter("o_orderkey < 0"), path + "-none") or files.path_exists(s.spark, path + "-none"):
        raise AssertionError("an empty input was written")
    return s.spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


SOURCE_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS row_count, 'success' AS status FROM {t}" for t in ("orders", "part", "supplier"))


@query("a06_batch_log", SOURCE_COUNTS)
def a06(s):
    log = scratch_path(s.spark, "batch-log")
    for name in ("orders", "part", "supplier"):
        files.log_batch(s.spark, log, "b1", name, None, s.source(name).count(), "success")
    return files.read_or_empty(s.spark, log, files.BATCH_LOG).select("source", "row_count", "status")


@query("a07_needs_ingest", """
SELECT * FROM (VALUES ('never logged', true), ('fewer rows stored', true), ('complete', false)) v(state, needed)""")
def a07(s):
    """The part table ingested partly, then wholly."""
    log, stored = scratch_path(s.spark, "batch-log"), scratch_path(s.spark, "stored")
    states = [("never logged", files.needs_ingest(s.spark, log, "part", stored))]
    files.log_batch(s.spark, log, "b1", "part", None, s.part.count(), "success")
    files.write_bronze(s.part.filter("p_size > 25"), stored)
    states.append(("fewer rows stored", files.needs_ingest(s.spark, log, "part", stored)))
    files.write_bronze(s.part, stored)
    states.append(("complete", files.needs_ingest(s.spark, log, "part", stored)))
    return s.spark.createDataFrame(states, "state string, needed boolean")


@query("a08_parquet_row_count", "SELECT count(*) AS n FROM lineitem")
def a08(s):
    return s.lineitem.agg(F.count("*").alias("n"))


def stat_sql(name, kind, quoted):
    """MD5 of name, type, the extremes as JSON objects, and the null count."""
    mark = '"' if quoted else ""
    show = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g')" if kind == "timestamp_ntz" else "CAST({} AS VARCHAR)"
    value = "{}({}) + 0.0" if kind == "double" else "{}({})"
    low, high = [f"""concat('{{"v":{mark}', {show.format(value.format(f, name))}, '{mark}}}')""" for f in ("min", "max")]
    return f"md5(concat_ws('|', '{name}', '{kind}', {low}, {high}, CAST(count(*) - count({name}) AS VARCHAR)))"


def fingerprint_sql(table, fields):
    sums = ", ".join(stat_sql(n, k, q) for n, k, q in fields)
    names = ", ".join(f'"{n}"' for n, _, _ in fields)
    return f"""SELECT '{table}' AS name, count(*) AS row_count, '[{names}]' AS column_names,
  md5(array_to_string(list_sort([{sums}]), ',')) AS stats_md5 FROM {table}"""


@query("a09_fingerprint", " UNION ALL ".join([
    fingerprint_sql("nation", [("n_nationkey", "int", False), ("n_name", "string", True), ("n_regionkey", "int", False)]),
    fingerprint_sql("region", [("r_regionkey", "int", False), ("r_name", "string", True)]),
]))
def a09(s):
    return union_all([files.fingerprint(s.nation, "nation"), files.fingerprint(s.region, "region")])


@query("a09_fingerprint_facts", " UNION ALL ".join([
    fingerprint_sql("lineitem", [
        ("l_orderkey", "bigint", False), ("l_partkey", "bigint", False), ("l_suppkey", "bigint", False), ("l_linenumber", "int", False),
        ("l_quantity", "double", False), ("l_extendedprice", "double", False), ("l_discount", "double", False), ("l_tax", "double", False),
        ("l_returnflag", "string", True), ("l_linestatus", "string", True), ("l_shipdate", "timestamp_ntz", True)]),
    fingerprint_sql("orders", [
        ("o_orderkey", "bigint", False), ("o_custkey", "bigint", False), ("o_orderstatus", "string", True), ("o_totalprice", "double", False),
        ("o_orderdate", "timestamp_ntz", True), ("o_orderpriority", "string", True)]),
]))
def a09_facts(s):
    return union_all([files.fingerprint(s.lineitem, "lineitem"), files.fingerprint(s.orders, "orders")])


@query("a10_check_delta", """
SELECT * FROM (VALUES ('orders', 'NO_DELTA'), ('part', 'DELTA'), ('supplier', 'UNKNOWN')) v(name, verdict)""")
def a10(s):
    """Saved: the orders as they are and the parts with one value changed per hundred."""
    store = files.FingerprintStore(s.spark, scratch_path(s.spark, "fingerprints"))
    edited = s.part.withColumn("p_retailprice", F.expr("CASE WHEN p_partkey % 100 = 0 THEN p_retailprice - 5000 ELSE p_retailprice END"))
    store.save(union_all([files.fingerprint(s.orders, "orders"), files.fingerprint(edited, "part")]))
    names = ("orders", "part", "supplier")
    return files.check_delta(union_all([files.fingerprint(s.source(n), n) for n in names]), store.load())


# A11, the JDBC read, has no query here: it needs a database server. Its options are tested instead.


@query("a12_read_query", """
SELECT o_orderpriority, count(*) AS n, max(o_orderdate) AS newest FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""")
def a12(s):
    s.orders.createOrReplaceTempView("marquee_orders")
    return jdbc.read_query(s.spark, """
        SELECT o_orderpriority, count(*) AS n, max(o_orderdate) AS newest
        FROM marquee_orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority""")


@query("a13_read_incremental", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def a13(s):
    return files.read_incremental(s.events.select("event_id", "ts"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


@query("a14_watermarks", """
SELECT 'customer' AS name, max(CAST(c_custkey AS VARCHAR)) AS mark FROM customer
UNION ALL SELECT 'orders', max(CAST(o_orderkey AS VARCHAR)) FROM orders""")
def a14(s):
    """Marks are text and compared as text; a cleared mark is gone."""
    store = files.WatermarkStore(s.spark, scratch_path(s.spark, "marks"))
    columns = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"}
    store.update(union_all([files.latest_watermark(s.source(t), c, t) for t, c in columns.items()]))
    store.clear("part")
    if store.get("part") != files.EPOCH:
        raise AssertionError("a cleared mark is still there")
    return store.all()


PEOPLE_MAP = {"nconst": "person_id", "primary_name": "name", "birth_year": "born", "no_such_column": "x"}


@query("a15_mapped_schema", """
SELECT 'person_id' AS name, 'bigint' AS type, count(nconst) AS known FROM name_basics
UNION ALL SELECT 'name', 'string', count(primary_name) FROM name_basics UNION ALL SELECT 'born', 'int', count(birth_year) FROM name_basics""")
def a15(s):
    """Name, type and known values of each column that the mapping keeps, read under its new name."""
    schema = files.infer_mapped_schema(s.name_basics, PEOPLE_MAP)
    mapped = files.map_columns(s.name_basics, PEOPLE_MAP)
    return union_all([
        mapped.agg(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.count(f.name).alias("known"))
        for f in schema.fields
    ])


@query("a16_map_columns", "SELECT nconst AS person_id, primary_name AS name, birth_year AS born FROM name_basics")
def a16(s):
    return files.map_columns(s.name_basics, PEOPLE_MAP)


@query("a17_align_schema", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, CAST(NULL AS VARCHAR) AS s_comment FROM supplier""")
def a17(s):
    aligned, added = files.evolve_as_text(s.supplier, ["s_suppkey", "s_name", "s_comment"])
    if added != ["s_comment"]:
        raise AssertionError(added)
    return aligned


EXPORTED = ["dim_title", "dim_person", "fact_episode", "fact_performance"]


def exported(s):
    path = scratch_path(s.spark, "gold")
    return path, files.export_marts({n: s.table(n) for n in EXPORTED}, path)


@query("a18_export_marts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" + (" WHERE title_type <> 'movie' OR runtime_minutes > 0" if n == "dim_title" else "")
    for n in EXPORTED))
def a18(s):
    return exported(s)[1]


SILVER = ["title_basics", "title_episode", "title_akas", "title_principal", "name_basics"]


@query("a19_export_silver", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in SILVER)
       + " UNION ALL SELECT 'title_rating', count(*) FROM title_rating"
       " UNION ALL SELECT 'title_genre', count(*) FROM (SELECT unnest(string_split(genres, ',')) FROM title_basics)")
def a19(s):
    from marquee.suite.marts import title_genre

    tables = {n: s.table(n) for n in SILVER} | {"title_rating": s.title_rating, "title_genre": title_genre(s)}
    return files.export_marts(tables, scratch_path(s.spark, "silver"), filters={})


@query("a20_register_marts", """
SELECT d.title_type, count(*) AS credits FROM fact_performance f JOIN dim_title d USING (tconst)
WHERE title_type <> 'movie' OR runtime_minutes > 0 GROUP BY ALL""")
def a20(s):
    path, _ = exported(s)
    files.register_marts(s.spark, path, EXPORTED, prefix="mart_")
    return jdbc.read_query(s.spark, """
        SELECT d.title_type, count(*) AS credits FROM mart_fact_performance f JOIN mart_dim_title d ON d.tconst = f.tconst
        GROUP BY d.title_type""")


@query("a21_collect_bounded", "SELECT title_type, count(*) AS n FROM dim_title GROUP BY ALL")
def a21(s):
    """A report is collected; the whole fact table is refused."""
    try:
        files.collect_bounded(s.fact_performance, max_rows=10)
    except ValueError:
        pass
    else:
        raise AssertionError("an oversized result was collected")
    report = s.dim_title.groupBy("title_type").agg(F.count("*").alias("n"))
    return s.spark.createDataFrame(files.collect_bounded(report))


FIVE_PERCENT = f"md5('42:' || CAST(tconst AS VARCHAR)) < '{int(0.05 * 16**8):08x}'"


@query("a22_key_sample", f"""
SELECT f.tconst, f.nconst, d.title_type FROM fact_performance f JOIN (SELECT * FROM dim_title WHERE {FIVE_PERCENT}) d ON d.tconst = f.tconst""")
def a22(s):
    titles = sampling.key_sample(s.dim_title.select("tconst", "title_type"), "tconst", 5)
    credits = sampling.key_sample(s.fact_performance.select("tconst", "nconst"), "tconst", 5)
    return credits.join(titles, "tconst")


@query("a23_sample_n", """
SELECT tconst, primary_title FROM dim_title ORDER BY md5('42:' || CAST(tconst AS VARCHAR)), tconst LIMIT 50000""")
def a23(s):
    return sampling.sample_n(s.dim_title.select("tconst", "primary_title"), 50_000, "tconst")


def subset(s):
    forced = s.dim_title.orderBy(F.desc_nulls_last("num_votes"), "tconst").limit(100).select("tconst")
    return sampling.subset_star(
        s.dim_title, s.dim_person, s.fact_performance, s.fact_episode, forced, "Story 12", F.md5(F.col("tconst").cast("string")) < "0d"
    )


SUBSET_SQL = """
WITH w AS (SELECT tconst FROM dim_title WHERE primary_title LIKE '%Story 12%' OR md5(CAST(tconst AS VARCHAR)) < '0d'
  UNION SELECT * FROM (SELECT tconst FROM dim_title ORDER BY num_votes DESC NULLS LAST, tconst LIMIT 100)),
e AS (SELECT * FROM fact_episode WHERE episode_key IN (FROM w)),
k AS (FROM w UNION SELECT series_key FROM e WHERE series_key IS NOT NULL),
c AS (SELECT * FROM fact_performance WHERE tconst IN (FROM k))
SELECT 'dim_title' AS table_name, tconst AS id, 1 AS n FROM dim_title WHERE tconst IN (FROM k)
UNION ALL SELECT 'fact_episode', episode_key, 1 FROM e
UNION ALL SELECT 'dim_person', nconst, 1 FROM dim_person WHERE nconst IN (SELECT nconst FROM c)
UNION ALL SELECT 'fact_performance', tconst, count(*) FROM c GROUP BY tconst"""


@query("a24_subset_star", SUBSET_SQL)
def a24(s):
    ids = {"dim_title": "tconst", "fact_episode": "episode_key", "dim_person": "nconst", "fact_performance": "tconst"}
    return union_all([
        df.groupBy(F.lit(name).alias("table_name"), F.col(ids[name]).alias("id")).agg(F.count("*").alias("n"))
        for name, df in subset(s).items()
    ])


READY = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@query("a25_sources_ready", " UNION ALL ".join(f"SELECT '{t}' AS source, count(*) AS row_count FROM {t}" for t in READY))
def a25(s):
    """Rows of seven sources, read once the gate finds that many files; it stays shut for more files than there are."""
    pattern = f"{s.sf_dir}/*.parquet"
    if not files.sources_ready(s.spark, pattern, len(READY)) or files.sources_ready(s.spark, pattern, 1000):
        raise AssertionError("the gate miscounts the files")
    return union_all([s.source(t).agg(F.lit(t).alias("source"), F.count("*").alias("row_count")) for t in READY])
