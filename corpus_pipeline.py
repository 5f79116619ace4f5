"""The corpus pipeline: documents in, encoded training text out. Each stage calls one operator and is written as Parquet.

Every stage but the last returns the columns of ``documents``. Null, empty and very long texts, ties, repeated rows and empty
tables pass through as the operators define; a null id never groups with another row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe, decontaminate, near_dup, pii, quality
from marquee.llm.common import table
from marquee.llm.queries import RANK_FILE
from marquee.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
POLICY = "v1"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy."""
    return quality.ledger(docs, COLUMNS).where(quality.passes(POLICY)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates (five-word shingles, 0.8).

    Of rows that share an id one stays; rows without an id all stay.
    """
    found = near_dup.near_duplicates(docs, size=5, percent=80)
    removed = found.where(~F.col("kept")).select("doc_id")
    left = docs.select(COLUMNS).join(removed, "doc_id", "left_anti")
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return left.withColumn("_alone", alone).dropDuplicates(["doc_id", "_alone"]).select(COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.find(docs, table(spark, sf_dir, "benchmark"), COLUMNS).where("not contaminated").select(COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text."""
    found = pii.detect(docs, COLUMNS, redacted=True)
    changed = F.size("spans") > 0
    return found.select(
        "doc_id", F.col("redacted").alias("text"), "lang", "source",
        F.when(changed, F.length("redacted").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text decoded from them."""
    path, pattern = public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN
    others = [c for c in COLUMNS if c != "text"]
    coded = bpe.encode_and_decode(docs, path, pattern, others)
    return coded.select(*others, F.col("decoded").cast("string").alias("text"), (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("byte-level BPE", encoding),
]

# Trained span classifier and token ids are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
