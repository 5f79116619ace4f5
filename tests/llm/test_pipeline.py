"""The pipeline against a brute-force version of its stages, and odd inputs."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import near_dup
from tests.conftest import DATA
from tests.llm.test_linked_operators import brute_near
from tests.llm.test_text_operators import brute_hits, brute_measures, brute_spans

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_pipeline(rows, items):
    """Ids that stay, with their texts before redaction."""
    kept = []
    for i, text in rows:
        words, _, symbols, _, repeated, _, exclaims, echoes = brute_measures(text)
        if words >= 10 and 100 * repeated <= 20 * words and 10 * symbols <= words and 10 * exclaims <= 3 * words and 10 * echoes <= 3 * words:
            kept.append((i, text))
    groups = brute_near(kept, 5)
    kept = [(i, t) for i, t in kept if groups[i][1] == i]
    return {i: t for i, t in kept if not brute_hits(t, items)[1]}


@pytest.fixture(scope="module")
def result(spark):
    folder = f"{DATA}/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    return brute_pipeline(docs, items), {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}


def test_the_same_documents_stay(result):
    want, got = result
    assert set(got) == set(want) and len(got) > 100


def test_texts_are_redacted_and_round_trip(result):
    want, got = result
    changed = 0
    for i, text in want.items():
        assert not any(brute_spans(got[i].text)), i
        if not any(brute_spans(text)):
            assert got[i].text == text and got[i].n_chars == len(text)
        else:
            changed += 1
            assert re.search("<(EMAIL|IP|CARD|PHONE)>", got[i].text) and got[i].n_chars == len(got[i].text)
        assert got[i].n_tokens * 4 == len(got[i].ids) > 0
    assert changed


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(None, good, None, None, None), (1, good, "en", "s", 1), (1, good, "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, good + " x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit("clash")).withColumn("id", F.lit("clash"))
    folder = f"{DATA}/sf0.001"
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{corpus_pipeline.scratch_path(spark, 'stage')}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert counts == [4, 2, 2, 2, 2]
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_near_duplicate_stage_broadcasts_no_exploded_index(spark, monkeypatch):
    """With Spark's default threshold the exploded index of signatures went through the driver."""
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts + [t + " end" for t in texts[:6]])], DOCS)
    plans, write = {}, near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and write(df, label))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(12))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    for label in ("near-members", "near-pairs"):
        assert "SortMergeJoin" in plans[label] and "BroadcastHashJoin" not in plans[label], label
