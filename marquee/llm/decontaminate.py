"""Benchmark passages in documents, found by Wu-Manber search over words.

Text is lower-cased (A-Z only) and split into words: runs of 0-9, a-z and characters outside ASCII. A test string is
a window of ``size`` consecutive words of an item; an item with fewer words, but not none, is one test string. For each
length of test strings a shift table says by the last two words under the cursor how far it may jump; at shift zero the
bucket of those two words gives the strings to compare directly.

Null text has no words. Items with the same id count once; a null item id counts as the empty string. Empty tables,
repeated rows and further columns are allowed: each document row gives one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import map_texts, text_bytes

WINDOW = 10
# Bytes of benchmark text in one search table; a larger benchmark is searched in as many passes as it has blocks.
BLOCK_BYTES = 16 << 20

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(data: bytes) -> list[bytes]:
    return data.translate(_WORD_BYTES).split()


class WuManber:
    """Search tables for test strings of one length, given with the items that hold them."""

    def __init__(self, length: int, strings: dict[tuple[bytes, ...], set[str]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = {}
        for string, items in strings.items():
            for end in range(self.block, length + 1):
                block = string[end - self.block : end]
                self.shift[block] = min(length - end, self.shift.get(block, self.far))
            self.buckets.setdefault(string[-self.block :], {})[string] = items

    def search(self, text: list[bytes]):
        """Start and items of every occurrence."""
        shift, far, length, block = self.shift.get, self.far, self.length, self.block
        end, last = length, len(text)
        while end <= last:
            under = (text[end - 2], text[end - 1]) if block == 2 else (text[end - 1],)
            jump = shift(under, far)
            if jump:
                end += jump
                continue
            found = self.buckets[under].get(tuple(text[end - length : end]))
            if found is not None:
                yield end - length, found
            end += 1


def test_strings(items: list[tuple[str, bytes]], size: int = WINDOW) -> dict[int, dict[tuple[bytes, ...], set[str]]]:
    """Test strings with their items, by length."""
    strings: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for item, data in items:
        ws = words(data)
        length = min(size, len(ws))
        for start in range(len(ws) - length + 1 if ws else 0):
            strings.setdefault(length, {}).setdefault(tuple(ws[start : start + length]), set()).add(item)
    return strings


def search(tables: list[WuManber], data: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Number of words, merged ranges of hit words (end exclusive), items found."""
    text = words(data)
    ranges, items = [], set()
    for table in tables:
        for start, found in table.search(text):
            ranges.append((start, start + table.length))
            items |= found
    merged: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return len(text), merged, sorted(items)


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """The benchmark in blocks of bounded size: counted first, then fetched one at a time."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), text_bytes(text).alias("data"))
    total = rows.agg(F.sum(F.length("data"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for i in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item", "data"), F.lit(n)) == i)
        yield [(r.item, bytes(r.data)) for r in block.toLocalIterator()]


def find(
    docs: DataFrame, benchmark: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", item: str = "item_id",
    item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``keys``, n_words, ``hits`` (ranges of hit words), ``items`` (ids as strings, sorted), n_hit, contaminated.

    Each block of the benchmark is one pass over the documents. The rows of several passes are brought together by the
    keys and a digest of the text; rows equal in both come back as often as they went in.
    """
    keys = list(keys)
    rows = docs.select(*keys, F.xxhash64(text).alias("__digest"), F.col(text).alias("__source"))
    passes = []
    for block in _blocks(benchmark, item, item_text, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(test_strings(block, size))

        def make(shared=shared):
            tables = [WuManber(length, strings) for length, strings in shared.value.items()]
            return lambda texts: [list(c) for c in zip(*(search(tables, data) for data in texts))]

        outputs = "n_words long, hits array<struct<start:int,end:int>>, items array<string>"
        passes.append(map_texts(rows, [*keys, "__digest"], text_bytes("__source"), outputs, make))
    found = reduce(DataFrame.unionAll, passes)
    if len(passes) > 1:
        found = found.groupBy(*keys, "__digest").agg(
            F.max("n_words").alias("n_words"),
            F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
            F.explode(F.array_repeat(F.lit(1), (F.count("*") / len(passes)).cast("int"))).alias("__copy"),
        )
    # Ranges of several passes may overlap: count each word once.
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n"),
            F.greatest(acc["end"], x["end"]).alias("end"),
        ),
        lambda acc: acc["n"].cast("long"),
    )
    found = found.withColumn("n_hit", covered).withColumn("contaminated", F.col("n_hit") > 0)
    return found.select(*keys, "n_words", "hits", "items", "n_hit", "contaminated")
