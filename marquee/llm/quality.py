"""Rule bitmask ledger: every rule is evaluated once per document and kept as one bit, policies only read the bits.

A word is a run of other characters than blank, tab, line feed, vertical tab, form feed and carriage return. Texts are
measured whole. Null text has no words and measures of zero, like the empty text. Repeated rows and null ids get one
ledger row each; further columns of the input are ignored, whatever their names. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import map_texts

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_exclaims long, n_echo_words long"
)

# Name and condition of failure, over the measures. The position is the bit; new rules go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "exclaims": "100 * n_exclaims > 30 * n_words",
    "echoes": "100 * n_echo_words > 30 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "long_words": "word_chars > 12 * n_words",
    "many_words": "n_words > 100000",
}

# Versions of the policy: a document is rejected if one of the named rules failed.
POLICIES: dict[str, Sequence[str]] = {
    "base": ("few_words", "repeats"),
    "v1": ("few_words", "repeats", "symbols", "exclaims", "echoes"),
    "strict": tuple(RULES),
}


def repeated_words(words: Sequence[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + size - max(end, start)
            end = start + size
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * 8
    words = text.encode().split()  # bytes split at exactly the blanks above
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        text.count("!"),
        sum(map(bytes.__eq__, words, words[1:])),
    )


def measured(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and the measures of each row."""

    def make():
        return lambda texts: [list(c) for c in zip(*map(measure, texts))]

    return map_texts(docs, keys, text, MEASURES, make)


def bits(rules: Mapping[str, str]) -> Column:
    """One long with bit i set where rule i failed."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules at most")
    return sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(rules.values())), F.lit(0).cast("long"))


def ledger(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", rules: Mapping[str, str] = RULES) -> DataFrame:
    """``keys``, the measures and ``failed``, the bits of the rules that failed."""
    return measured(docs, keys, text).withColumn("failed", bits(rules))


def mask(names: Sequence[str], rules: Mapping[str, str] = RULES) -> int:
    order = list(rules)
    return sum(1 << order.index(name) for name in set(names))


def passes(policy: str, failed: str = "failed") -> Column:
    """Whether a ledger row passes a version of the policy."""
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def ablation(entries: DataFrame, policy: str, rules: Mapping[str, str] = RULES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and that would stay without it.

    Rows are counted per pattern of bits first, so what follows has at most as many rows as there are patterns.
    """
    whole = mask(POLICIES[policy], rules)
    patterns = entries.groupBy(F.col("failed").bitwiseAND(F.lit(whole).cast("long")).alias("pattern")).agg(F.count("*").alias("n"))
    named = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(mask([name], rules)).cast("long").alias("bit")) for name in POLICIES[policy]])
    hit = F.col("pattern").bitwiseAND(F.col("r.bit")) != 0
    return (
        patterns.select("pattern", "n", F.explode(named).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("pattern") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("pattern").bitwiseAND(F.lit(whole).cast("long") - F.col("r.bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
