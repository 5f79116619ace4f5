"""What the text operators share: reading tables, passing texts to Python in Arrow batches, worker-wide caches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import scratch_path

# Bytes of text that are Python objects at one time in a task; a longer text is handled alone.
SLICE_BYTES = 8 << 20
# Rows up to which a side of a join may be broadcast, where Spark's guess of its bytes allows it.
FEW_ROWS = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shuffled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A side of a join that is shuffled, unless it is known to have ``FEW_ROWS`` at most.

    Before it runs, Spark takes a list for one element, an explode for one row per row and a file for its compressed size,
    so it would broadcast tables far above its threshold through the driver.
    """
    return df if rows is not None and rows <= FEW_ROWS else df.hint("merge")


def text_bytes(column: str | Column = "text") -> Column:
    """UTF-8 bytes of a text, none for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def worker_cache(name: str, make: Callable[[], object]):
    """A value built once in each Python worker and kept for its later tasks."""
    kept = vars(sys).setdefault("_marquee_llm", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text each."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def map_texts(
    df: DataFrame, keys: Sequence[str], text: str | Column, outputs: str, make: Callable[[], Callable[[list], list[list]]],
) -> DataFrame:
    """One output row per row: ``keys`` unchanged, then the columns of ``outputs`` computed from ``text``.

    ``make`` runs once per task and returns a function from a list of texts to a list of columns; its attribute ``done``,
    if it has one, is called at the end of the task. Texts become Python objects in slices of bounded bytes, so rows per
    Arrow batch do not decide the memory. A text that is also a key travels once.
    """
    again = isinstance(text, str) and text in keys
    column = F.col(f"`{text}`") if isinstance(text, str) else text
    kept = df.select(*[F.col(f"`{k}`") for k in keys], *([] if again else [column.alias("__text")]))
    session = df.sparkSession
    schema = session.createDataFrame([], outputs).schema
    types = [(f.name, f.dataType) for f in schema]
    full = kept.drop("__text").schema
    for field in schema:
        full = full.add(field)
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [(name, to_arrow_type(kind)) for name, kind in types]
    names = list(keys)
    place = names.index(text) if again else len(names)

    def run(batches):
        work = make()
        for batch in batches:
            for start, end in slices(batch.column(place)):
                part = batch.slice(start, end - start)
                made = work(part.column(place).to_pylist())
                arrays = [part.column(i) for i in range(len(names))]
                arrays += [m if isinstance(m, pa.Array) else pa.array(m, kind) for m, (_, kind) in zip(made, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names=names + [n for n, _ in arrow])
        # The worker stays for other tasks: give back what this one held.
        getattr(work, "done", lambda: None)()
        pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, full)
