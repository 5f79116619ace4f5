"""URL filter: allow and block rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and the start of a path; it fits its host and all subdomains, and the longest fitting rule decides.
URLs that a rule decides are the labelled ones. Trees learn from them: lengths, depth, digit ratio, entropy, parameters,
hyphens, labels, and the share of blocked URLs under the host's suffix. Everything is DataFrame and Spark ML work.

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and features of an empty string.
Without labelled URLs of both kinds there is nothing to learn: the kind that exists decides, else "allow". Ids may be null
or repeated; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict, host and path start.
RULES: Sequence[tuple[str, str, str]] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Labelled URLs the trees are fitted on, at most about this many; which ones, a digest of the URL decides.
SAMPLE_ROWS = 20_000
TREES, DEPTH = 20, 4
SMOOTHING = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "host_hyphens", "path_depth", "digit_ratio", "host_digit_ratio",
    "entropy", "host_entropy", "n_parameters", "has_query", "has_fragment", "has_extension", "longest_label", "suffix_blocked", "suffix_known",
)


def host(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _decided(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule and its verdict; of equally long ones that with the longer host."""
    found = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        none = F.lit(None).cast("struct<rule:string,verdict:string>")
        found = F.when(fits, value).otherwise(none if found is None else found)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    size = F.greatest(F.size(chars), F.lit(1))
    counts = F.aggregate(
        F.transform(F.array_distinct(chars), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))),
        F.lit(0.0),
        lambda acc, n: acc - n / size * F.log2(n / size),
    )
    return F.coalesce(counts, F.lit(0.0))


def _digit_ratio(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, "0123456789", ""))) / F.greatest(F.length(text), F.lit(1))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need nothing but the URL, and ``suffix``, its host's last label."""
    url, name, way = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(name, r"\.")
    return urls.withColumns({
        "suffix": F.element_at(labels, -1),
        "url_length": F.length(url),
        "host_length": F.length(name),
        "path_length": F.length(way),
        "host_labels": F.size(labels),
        "host_hyphens": F.length(name) - F.length(F.translate(name, "-", "")),
        "path_depth": F.size(F.filter(F.split(way, "/"), lambda p: p != "")),
        "digit_ratio": _digit_ratio(url),
        "host_digit_ratio": _digit_ratio(name),
        "entropy": entropy(url),
        "host_entropy": entropy(name),
        "n_parameters": F.size(F.filter(F.split(query, "&"), lambda p: p != "")),
        "has_query": url.contains("?").cast("int"),
        "has_fragment": url.contains("#").cast("int"),
        "has_extension": way.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
        "longest_label": F.array_max(F.transform(labels, lambda p: F.length(p))),
    })


def _with_suffixes(rows: DataFrame, suffixes: DataFrame, share: float) -> DataFrame:
    """Adds the smoothed share of blocked URLs under the suffix, and how many were labelled."""
    known = F.coalesce("n", F.lit(0))
    return rows.join(suffixes, "suffix", "left").withColumns({
        "suffix_blocked": (F.coalesce("n_blocked", F.lit(0)) + F.lit(SMOOTHING * share)) / (known + SMOOTHING),
        "suffix_known": F.log1p(known),
    }).drop("n", "n_blocked")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", sample: int = SAMPLE_ROWS) -> DataFrame:
    """``key``, host, path, rule, verdict and ``p_block`` (the trees' probability, null where a rule decides)."""
    urls = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host(url).alias("host"), path(url).alias("path"))
    urls = urls.withColumn("decided", _decided(rules))
    kinds = {r.verdict: r.n for r in urls.where("decided is not null").groupBy("decided.verdict").agg(F.count("*").alias("n")).collect()}
    allowed, blocked = kinds.get("allow", 0), kinds.get("block", 0)
    if not allowed or not blocked:
        only = "block" if blocked else "allow"
        rows = urls.withColumn("verdict", F.coalesce("decided.verdict", F.lit(only))).withColumn("p_block", F.lit(None).cast("double"))
        return rows.select(F.col("key").alias(key), "host", "path", F.col("decided.rule").alias("rule"), "verdict", "p_block")

    share = blocked / (allowed + blocked)
    rows = lexical(urls)
    suffixes = rows.where("decided is not null").groupBy("suffix").agg(
        F.count("*").alias("n"), F.count_if(F.col("decided.verdict") == "block").alias("n_blocked"),
    )
    rows = _with_suffixes(rows, suffixes, share)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    steps = 1 << 20
    part = min(steps, max(1, steps * sample // (allowed + blocked)))
    labelled = rows.where("decided is not null").where(F.pmod(F.xxhash64("url"), F.lit(steps)) < part)
    labelled = labelled.withColumn("label", (F.col("decided.verdict") == "block").cast("double"))
    labelled = labelled.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    # A few thousand rows: few partitions make the many small rounds cheap.
    training = assembler.transform(labelled.select("label", "weight", "url", *FEATURES)).select("label", "weight", "features").coalesce(2)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, weightCol="weight", checkpointInterval=-1, minInstancesPerNode=5).fit(training)
    scored = trees.transform(assembler.transform(rows))
    p_block = F.when(F.col("decided").isNull(), F.element_at(vector_to_array("probability"), 2))
    verdict = F.coalesce("decided.verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    scored = scored.withColumn("p_block", p_block).withColumn("verdict", verdict)
    return scored.select(F.col("key").alias(key), "host", "path", F.col("decided.rule").alias("rule"), "verdict", "p_block")
