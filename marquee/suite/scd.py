"""Change data and incremental builds."""

from pyspark.sql import functions as F

from marquee.operators import scd
from marquee.operators.paging import union_all
from marquee.session import scratch_path
from marquee.sources import files
from marquee.suite.core import query

ATTRS = ["c_name", "c_nationkey", "c_mktsegment"]
T1, T2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"
# Two loads of the customers: the second renames some, blanks some, lacks some and adds some.
LOAD_1 = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 11 <> 3"
LOAD_2 = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 1 THEN concat(c_name, ' II') ELSE c_name END AS c_name, c_nationkey,
  CASE WHEN c_custkey % 13 = 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 17 <> 4"""


def loads(s):
    one = s.customer.filter("c_custkey % 11 <> 3").select("c_custkey", *ATTRS)
    two = s.customer.filter("c_custkey % 17 <> 4").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 7 = 1 THEN concat(c_name, ' II') ELSE c_name END AS c_name", "c_nationkey",
        "CASE WHEN c_custkey % 13 = 5 THEN NULL ELSE c_mktsegment END AS c_mktsegment",
    )
    return one, two


def moment(text):
    return F.lit(text).cast("timestamp_ntz")


def history(s, **options):
    one, two = loads(s)
    base = scd.first_load(one, ATTRS, moment(T1), "b1")
    return scd.scd2_merge(base, two, "c_custkey", ATTRS, moment(T2), "b2", **options)


HASH = "md5(concat_ws('|', ifnull(c_name, ''), ifnull(CAST(c_nationkey AS VARCHAR), ''), ifnull(c_mktsegment, '')))"
HISTORY_SQL = f"""
a AS (SELECT *, {HASH} AS attr_hash FROM ({LOAD_1})), b AS (SELECT *, {HASH} AS attr_hash FROM ({LOAD_2})),
h AS (
  SELECT a.*, TIMESTAMP '{T1}' AS valid_from, CASE WHEN b.attr_hash <> a.attr_hash THEN TIMESTAMP '{T2}' END AS valid_to,
    NOT coalesce(b.attr_hash <> a.attr_hash, false) AS is_current, 'b1' AS batch_id FROM a LEFT JOIN b USING (c_custkey)
  UNION ALL BY NAME
  SELECT b.*, TIMESTAMP '{T2}' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, true AS is_current, 'b2' AS batch_id
  FROM b LEFT JOIN a USING (c_custkey) WHERE a.attr_hash IS NULL OR a.attr_hash <> b.attr_hash)"""


@query("h01_scd2_merge", f"WITH {HISTORY_SQL} SELECT * FROM h")
def h01(s):
    return history(s)


@query("h01_scd2_rerun", f"WITH {HISTORY_SQL} SELECT * FROM h")
def h01_rerun(s):
    """The same load again, later, changes nothing."""
    _, two = loads(s)
    return scd.scd2_merge(history(s), two, "c_custkey", ATTRS, moment("2024-03-01 00:00:00"), "b3")


@query("h01_scd2_expire_missing", f"""
WITH {HISTORY_SQL} SELECT is_current, batch_id, count(*) AS n FROM
  (SELECT batch_id, is_current AND c_custkey IN (SELECT c_custkey FROM b) AS is_current FROM h) GROUP BY ALL""")
def h01_expire(s):
    return history(s, expire_missing=True).groupBy("is_current", "batch_id").agg(F.count("*").alias("n"))


@query("h02_overwrite", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def h02(s):
    path = scratch_path(s.spark, "reload")
    scd.overwrite(s.part.select("p_partkey"), path)
    scd.overwrite(s.part.select("p_partkey", "p_type"), path)
    return s.spark.read.parquet(path).groupBy("p_type").agg(F.count("*").alias("n"))


@query("h03_upsert", f"""
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM ({LOAD_2}) UNION ALL
SELECT * FROM ({LOAD_1}) WHERE c_custkey NOT IN (SELECT c_custkey FROM ({LOAD_2}))""")
def h03(s):
    return scd.upsert(*loads(s), ["c_custkey"])


@query("h04_since", """
SELECT title_id AS tconst, ordering, ingested_at FROM title_akas WHERE ingested_at > (SELECT max(ingested_at) FROM title_basics WHERE batch_id = 'b1998')""")
def h04(s):
    target = s.title_basics.filter("batch_id = 'b1998'")
    return scd.since(s.title_akas.select(F.col("title_id").alias("tconst"), "ordering", "ingested_at"), target, "ingested_at")


@query("h05_append_new_columns", f"""
SELECT c_custkey, c_name, c_nationkey, c_mktsegment, CAST(NULL AS DOUBLE) AS c_acctbal FROM ({LOAD_1})
WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT c_custkey, c_name, c_nationkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal < 0""")
def h05(s):
    target = loads(s)[0]
    delta = s.customer.filter("c_acctbal < 0").select("c_custkey", *ATTRS, "c_acctbal")
    aligned, _, _ = files.align_schema(target, delta.schema)
    return scd.upsert(aligned, delta, ["c_custkey"])


@query("h06_current", f"WITH {HISTORY_SQL} SELECT c_custkey, c_name FROM h WHERE valid_to IS NULL")
def h06(s):
    return scd.current(history(s)).select("c_custkey", "c_name")


@query("h07_stage", """
SELECT title_id, title AS aka_title, region, language, is_original_title AS original_flag FROM title_akas""")
def h07(s):
    names = {"title_id": "title_id", "title": "aka_title", "region": "region", "language": "language", "is_original_title": "original_flag"}
    return scd.stage(s.title_akas, names)


@query("h08_stage_checkpoints", """
SELECT DISTINCT p.pipeline, st.stage, p.pipeline <> 'BUILDING' AND st.stage = 'parents_done' OR p.pipeline = 'MACHINERY' AS done
FROM (SELECT c_mktsegment AS pipeline FROM customer) p, (VALUES ('parents_done'), ('children_done')) st(stage)""")
def h08(s):
    """One run per market segment: two stop early, the rest mark what they finished."""
    marks = scd.Checkpoint(s.spark, scratch_path(s.spark, "marks"), ["parents_done", "children_done"])
    pipelines = s.customer.select(F.col("c_mktsegment").alias("pipeline")).distinct()
    finished = pipelines.filter("pipeline <> 'BUILDING'").select(
        "pipeline", F.when(F.col("pipeline") == "MACHINERY", "children_done").otherwise("parents_done").alias("stage"),
        F.lit("b1").alias("batch_id"), F.lit(T1).cast("timestamp").alias("marked_at"),
    )
    finished.write.mode("append").parquet(marks.path)
    reached = marks.table().select("pipeline", F.expr("array_position(array('parents_done', 'children_done'), stage)").alias("level"))
    stages = F.explode(F.array(*[F.struct(F.lit(x).alias("stage"), F.lit(i + 1).alias("need")) for i, x in enumerate(marks.stages)]))
    grid = pipelines.select("pipeline", stages.alias("_e")).select("pipeline", "_e.*").join(reached, "pipeline", "left")
    return grid.select("pipeline", "stage", F.coalesce(F.col("level") >= F.col("need"), F.lit(False)).alias("done"))


@query("h09_plan_rebuild", """
SELECT * FROM (VALUES ('title_genre', 'customer', true), ('title_director', 'supplier', false),
  ('title_writer', 'part', true)) v(target, source, rebuild)""")
def h09(s):
    """Fingerprints of an earlier load against this one: one source changed, one is equal, one was never seen."""
    one, two = loads(s)
    old = union_all([files.fingerprint(one, "title_genre"), files.fingerprint(s.supplier, "title_director")])
    new = union_all([
        files.fingerprint(two, "title_genre"), files.fingerprint(s.supplier, "title_director"), files.fingerprint(s.part, "title_writer")
    ])
    verdicts = files.check_delta(new, old).withColumnRenamed("name", "target")
    children = verdicts.select("target", F.expr(
        "CASE target WHEN 'title_genre' THEN 'customer' WHEN 'title_director' THEN 'supplier' ELSE 'part' END").alias("source"))
    return scd.plan_rebuild(children, verdicts)


@query("h10_as_of", f"""
WITH {HISTORY_SQL} SELECT c_custkey, c_name, c_mktsegment FROM h
WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to > TIMESTAMP '2024-01-15' OR valid_to IS NULL)""")
def h10(s):
    return scd.as_of(history(s), moment("2024-01-15 00:00:00")).select("c_custkey", "c_name", "c_mktsegment")
