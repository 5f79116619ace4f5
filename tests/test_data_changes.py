"""History, upserts, sources and stores."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from marquee.operators import scd
from marquee.session import scratch_path
from marquee.sources import files, jdbc, sampling

ATTRS = ["v"]


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.fixture
def loads(spark):
    one = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k4", None), ("k5", "x")], "k string, v string")
    two = spark.createDataFrame([("k1", "a"), ("k2", "c"), ("k3", "d"), ("k4", None)], "k string, v string")
    return one, two


def versions(df):
    return sorted((r["k"], r["v"], r["is_current"], r["valid_to"] is None, r["batch_id"]) for r in df.collect() if r["v"] is not None)


def test_scd2(spark, loads):
    one, two = loads
    base = scd.first_load(one, ATTRS, at("2024-01-01"), "b1")
    merged = scd.scd2_merge(base, two, "k", ATTRS, at("2024-02-01"), "b2")
    assert versions(merged) == [
        ("k1", "a", True, True, "b1"), ("k2", "b", False, False, "b1"), ("k2", "c", True, True, "b2"), ("k3", "d", True, True, "b2"),
        ("k5", "x", True, True, "b1"),
    ]
    assert merged.filter("k = 'k4'").count() == 1
    again = scd.scd2_merge(merged, two, "k", ATTRS, at("2024-03-01"), "b3")
    assert versions(again) == versions(merged) and again.count() == merged.count()
    gone = scd.scd2_merge(base, two, "k", ATTRS, at("2024-02-01"), "b2", expire_missing=True)
    assert gone.filter("k = 'k5'").first()["is_current"] is False


def test_scd2_null_hash_expires_once(spark, loads):
    """A current row without a hash is closed and replaced, not doubled."""
    one, two = loads
    base = scd.first_load(one, ATTRS, at("2024-01-01"), "b1").withColumn("attr_hash", F.lit(None).cast("string"))
    merged = scd.scd2_merge(base, two, "k", ATTRS, at("2024-02-01"), "b2")
    assert merged.filter("is_current").groupBy("k").count().filter("count > 1").isEmpty()


def test_as_of_and_upsert(spark, loads, rows):
    one, two = loads
    merged = scd.scd2_merge(scd.first_load(one, ATTRS, at("2024-01-01"), "b1"), two, "k", ATTRS, at("2024-02-01"), "b2")
    assert rows(scd.as_of(merged, at("2024-01-15")).filter("k = 'k2'"), "v") == [("b",)]
    assert rows(scd.as_of(merged, at("2024-02-01")).filter("k = 'k2'"), "v") == [("c",)]
    assert rows(scd.upsert(one, two, ["k"])) == [("k1", "a"), ("k2", "c"), ("k3", "d"), ("k4", None), ("k5", "x")]


def test_stage_marks(spark):
    marks = scd.Checkpoint(spark, scratch_path(spark, "marks"), ["parents", "children"])
    assert not marks.done("p", "parents", "b1")
    marks.mark("p", "children", "b1")
    assert marks.done("p", "parents", "b1") and marks.done("p", "children", "b1") and not marks.done("p", "parents", "b2")
    with pytest.raises(ValueError):
        marks.mark("p", "nothing", "b1")


def test_children_follow_their_own_verdict(spark, rows):
    children = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "s")], "target string, source string")
    verdicts = spark.createDataFrame([("a", "NO_DELTA"), ("b", "DELTA")], "target string, verdict string")
    assert rows(scd.plan_rebuild(children, verdicts), "target", "rebuild") == [("a", False), ("b", True), ("c", True)]


TSV = 'tconst\taverageRating\tnumVotes\ntt1\t6.3\t154\ntt2\t\\N\t"120\ntt3\t5.9\n'


def test_raw_tsv(spark, tmp_path):
    path = tmp_path / "r.tsv.gz"
    path.write_bytes(gzip.compress(TSV.encode()))
    got = [tuple(r) for r in files.read_raw_tsv(spark, str(path), files.raw_schema("title.ratings"), partitions=2).orderBy("tconst").collect()]
    assert got == [("tt1", "6.3", "154"), ("tt2", "\\N", '"120'), ("tt3", "5.9", None)]
    good, bad, problem = files.validate_source(spark, str(path), 3)
    assert (good.count(), bad.count(), problem) == (3, 1, None)
    sums = files.file_checksums(spark, str(tmp_path / "*.gz")).collect()
    assert [r["checksum"] for r in sums] == [hashlib.sha256(path.read_bytes()).hexdigest()]


def test_missing_and_empty_source(spark, tmp_path):
    assert files.validate_source(spark, str(tmp_path / "none.tsv"), 3)[2] == "missing"
    (tmp_path / "empty.tsv").write_text("")
    assert files.validate_source(spark, str(tmp_path / "empty.tsv"), 3)[2] == "empty"
    assert not files.write_bronze(spark.createDataFrame([], "a string"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_fingerprint_sees_changed_value(spark):
    one = spark.createDataFrame([("tt1", "A"), ("tt2", "B")], "tconst string, title string")
    two = spark.createDataFrame([("tt1", "A"), ("tt2", "C")], "tconst string, title string")
    store = files.FingerprintStore(spark, scratch_path(spark, "fp"))
    assert store.verdict(one, "t") == "UNKNOWN"
    store.save(files.fingerprint(one, "t"))
    store.save(files.fingerprint(two, "other"))
    assert (store.verdict(one, "t"), store.verdict(two, "t")) == ("NO_DELTA", "DELTA")
    broken = spark.createDataFrame([(1,)], "a int").select((F.lit(1) / (F.col("a") - 1)).alias("x"))
    assert store.verdict(broken, "t") == "UNKNOWN"


def test_errors_of_the_program_are_not_verdicts(spark, tmp_path):
    store = files.FingerprintStore(spark, scratch_path(spark, "fp"))
    with pytest.raises(AttributeError):
        store.verdict(None, "t")
    (tmp_path / "a.parquet").write_text("nonsense")
    assert store.verdict(spark.read.schema("a int").parquet(str(tmp_path)), "t") == "UNKNOWN"
    marks = files.WatermarkStore(spark, str(tmp_path))
    assert marks.get("t") == files.EPOCH
    assert files.fails_to_read(_error(lambda: spark.read.parquet(str(tmp_path / "none")))) and not files.fails_to_read(_error(lambda: spark.range(1).select("zz")))


def _error(call):
    with pytest.raises(Exception) as caught:
        call()
    return caught.value


def test_export_counts_what_it_writes(spark, tmp_path):
    tables = {"a": spark.range(7).toDF("x"), "none": spark.createDataFrame([], "x int"), "kept": spark.range(10).toDF("x")}
    manifest = files.export_marts(tables, str(tmp_path), filters={"kept": lambda df: df.filter("x > 6")})
    assert {r["table_name"]: r["row_count"] for r in manifest.collect()} == {"a": 7, "none": 0, "kept": 3}
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 3
    assert spark.read.json(str(tmp_path / "_manifest")).count() == 3


def test_watermarks(spark):
    store = files.WatermarkStore(spark, scratch_path(spark, "wm"))
    assert store.get("t") == files.EPOCH
    store.set("t", "2024-01-01")
    store.set("t", "2024-02-01")
    store.set("u", "9")
    assert store.get("t") == "2024-02-01"
    store.clear("t")
    assert store.get("t") == files.EPOCH and [r["name"] for r in store.all().collect()] == ["u"]
    marks = spark.createDataFrame([("9",), ("10",)], "v string")
    assert files.latest_watermark(marks, "v", "x").first()["mark"] == "9"


def test_schema_alignment(spark):
    df = spark.createDataFrame([(1, "x")], "a int, old string")
    aligned, added, extra = files.align_schema(df, files.text_schema(["a", "b"]))
    assert (aligned.columns, added, extra) == (["a", "old", "b"], ["b"], ["old"])
    assert files.map_columns(df, {"a": "A", "zz": "Z"}).columns == ["A"]
    assert files.map_columns(files.map_columns(df, {"a": "A"}), {"a": "A"}, reverse=True).columns == ["a"]


def test_jdbc_options():
    plain = jdbc.jdbc_options("jdbc:x", "t")
    assert plain["dbtable"] == "t" and "partitionColumn" not in plain
    ranged = jdbc.jdbc_options("jdbc:x", "t", ("id", 0, 100, 8), {"user": "u"})
    assert (ranged["partitionColumn"], ranged["lowerBound"], ranged["upperBound"], ranged["numPartitions"]) == ("id", "0", "100", "8")
    assert ranged["user"] == "u"


def test_key_sample_is_nested_and_joins(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    five = {r["k"] for r in sampling.key_sample(df, "k", 5).collect()}
    ten = {r["k"] for r in sampling.key_sample(df, "k", 10).collect()}
    assert five < ten and 180 < len(five) < 330 and sampling.key_sample(df, "k", 100).count() == 5000
    assert {r["k"] for r in sampling.key_sample(df.repartition(7), "k", 5).collect()} == five
    assert sampling.sample_n(df, 50, "k").count() == 50


def test_bounded_collect(spark):
    df = spark.range(11)
    assert len(files.collect_bounded(df, 11)) == 11
    with pytest.raises(ValueError):
        files.collect_bounded(df, 10)
