"""Connected components of a graph given as links, by alternating star contraction.

Large-star links every larger neighbour of a node to the node's least neighbour, small-star every smaller one. Both are
an aggregation of minima and a join, so a node with very many links never gathers them in one task. Rounds end when the
links no longer change; each is written to the shared folder. The links are counted in every round, so its stages get as
many tasks as the rows need, not one per shuffle partition: a graph of a few thousand links would spend its rounds on
starting tasks and writing empty files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import shuffled, written

# Links per task; there are no fewer tasks than cores.
TASK_ROWS = 1 << 16


def tasks(df: DataFrame, rows: int) -> int:
    """Tasks that work on so many links."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _least(links: DataFrame, node: str, other: str) -> DataFrame:
    return links.groupBy(F.col(node).alias("node")).agg(F.least(F.min(other), F.first(node)).alias("least"))


def _rounds(links: DataFrame, rows: int) -> DataFrame:
    """One large-star and one small-star step over so many links with a > b."""
    few = tasks(links, rows)
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    large = both.join(shuffled(_least(both, "x", "y").coalesce(few), rows), F.col("x") == F.col("node")).where("y > x")
    large = large.select(F.col("y").alias("a"), F.col("least").alias("b")).where("a <> b").coalesce(few)
    small = large.join(shuffled(_least(large, "a", "b").coalesce(few), rows), F.col("a") == F.col("node"))
    small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("l"))
    return small.coalesce(few).select("l.a", "l.b").where("a <> b").distinct().coalesce(few)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (the least id reached) of every node with a link to another node."""
    few = tasks(links, links.count())
    links = written(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct().coalesce(few), "components")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        links = written(_rounds(links, state[0]), "components")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct().coalesce(tasks(links, state[0]))
    )
