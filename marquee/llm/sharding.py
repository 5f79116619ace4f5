"""Shards of equal bytes by histogram sort.

Rows are ordered by a digest of the text, then by id, so equal texts lie side by side and the order is unrelated to the
source. Splitters are places in this order. Each round counts, for every splitter that is still open, the exact bytes
and rows in the sub-ranges of its range, in one aggregation over compact keys, and goes on in the sub-range that holds
the target, until a bound is within the tolerance or the range holds a single key. Then the rows are exchanged once,
into buckets between splitters; shards are whole buckets, and counts below each splitter give every row its slot.

Defined cases: a null text has the digest and size of no text; a null id sorts first; rows equal in text and id are one
key and never part, so a shard may exceed its share by such a key; an empty table gives no rows. Columns of the input
stay, except that those named shard or slot are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm.common import text_bytes
from marquee.session import scratch_path

ROW_BYTES = 16
KEY_BITS = 64  # of the digest; the id's bits follow
STEP_BITS = 8  # a range is cut into 256 sub-ranges per round


def size_of(text: str = "text") -> Column:
    return (F.length(text_bytes(text)) + ROW_BYTES).cast("long")


def _prefix(bits: int, id_bits: int) -> Column:
    """The first ``bits`` bits of the key, as one or two longs in a struct."""
    if bits <= KEY_BITS:
        high, low = F.shiftrightunsigned(F.col("k"), KEY_BITS - bits) if bits < KEY_BITS else F.col("k"), F.lit(0).cast("long")
    else:
        high, low = F.col("k"), F.shiftrightunsigned(F.col("d"), id_bits - (bits - KEY_BITS))
    return F.struct(high.alias("h"), low.alias("l"))


def _unsigned(value: int) -> int:
    return value + (1 << 64) if value < 0 else value


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


class _Splitter:
    """One splitter's range [start, start + 2^(total - bits)) of keys and the bytes and rows below its start."""

    def __init__(self, target: int):
        self.target, self.prefix, self.bits, self.bytes, self.rows, self.done = target, 0, 0, 0, 0, False


def splitters(keys: DataFrame, n: int, id_bits: int, total: int, tolerance: int) -> list[tuple[int, int, int]]:
    """Up to ``n - 1`` bounds (key, bytes below, rows below), near i/n of all bytes each.

    ``keys`` has k (digest as unsigned 64 bits), d (id moved to start at 0), size. A round collects at most 256 counts
    per open splitter, so what reaches the driver is bounded by ``n``, not by the rows.
    """
    whole = KEY_BITS + id_bits
    open_ = [_Splitter(total * i // n) for i in range(1, n)]
    done: list[_Splitter] = []
    bits, first = 0, max(STEP_BITS, (4 * n).bit_length())
    while open_:
        new_bits = min(bits + (STEP_BITS if bits else first), KEY_BITS if bits < KEY_BITS else whole)
        counted = keys.select(_prefix(new_bits, id_bits).alias("p"), _prefix(bits, id_bits).alias("q"), "size") if bits else keys.select(_prefix(new_bits, id_bits).alias("p"), "size")
        if bits:
            ranges = sorted({s.prefix for s in open_})
            schema = T.StructType([T.StructField("qh", T.LongType()), T.StructField("ql", T.LongType())])
            cut = max(0, bits - KEY_BITS)
            rows = [(_signed(r >> cut), r & ((1 << cut) - 1)) for r in ranges]
            wanted = keys.sparkSession.createDataFrame(rows, schema)  # at most n - 1 rows
            counted = counted.join(F.broadcast(wanted), (F.col("q.h") == F.col("qh")) & (F.col("q.l") == F.col("ql")))
        low_bits = max(0, new_bits - KEY_BITS)
        found: dict[int, list[tuple[int, int, int, bool]]] = {}
        for r in counted.groupBy("p").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
            p = (_unsigned(r.p.h) << low_bits) | r.p.l
            found.setdefault(p >> (new_bits - bits) if bits else 0, []).append((p, r.bytes, r.rows))
        found = {q: sorted(rows) for q, rows in found.items()}
        for s in open_:
            below, rows, best = s.bytes, s.rows, None
            for p, size, count in found[s.prefix]:
                # Bounds on either side of this sub-range; go on inside it if neither is near enough.
                if below + size > s.target or (p, size, count) == found[s.prefix][-1]:
                    inside = (p, below, rows, size, count)
                    break
                below, rows = below + size, rows + count
            p, below, rows, size, count = inside
            under, over = abs(s.target - below), abs(below + size - s.target)
            s.prefix, s.bits, s.bytes, s.rows = p, new_bits, below, rows
            if min(under, over) <= tolerance or new_bits == whole:
                if over < under:
                    s.prefix, s.bytes, s.rows = p + 1, below + size, rows + count
                s.done = True
        done += [s for s in open_ if s.done]
        open_ = [s for s in open_ if not s.done]
        bits = new_bits
    return sorted({(s.prefix << (whole - s.bits), s.bytes, s.rows) for s in done})


def histogram_sort(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", tolerance: float = 0.0005) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; shards hold about equal bytes.

    ``tolerance`` is the share of a shard's bytes by which a bound may miss its target. The number of buckets follows
    ``spark.sql.shuffle.partitions``: a shard is as many buckets as make at least that many in all.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "shard-keys")
    # Compact keys, written once: the rounds read these, never the texts.
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    whole_numbers = dict(docs.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    number = F.col(f"`{key}`").cast("long") if whole_numbers else F.shiftrightunsigned(F.xxhash64(f"`{key}`"), 4)
    docs.select(digest.alias("k"), number.alias("id"), size_of(text).alias("size")).write.parquet(path)
    keys = spark.read.parquet(path)
    total, rows, low, high = keys.agg(F.sum("size"), F.count("*"), F.min("id"), F.max("id")).first()
    total, low, high = total or 0, low or 0, high or 0
    id_bits = (high - low + 1).bit_length()
    if id_bits > 62:  # ids all over the range of long: their digests decide between equal texts
        number, low, id_bits = F.shiftrightunsigned(F.xxhash64(number), 4), 0, 61
        keys = keys.withColumn("id", F.shiftrightunsigned(F.xxhash64("id"), 4))
    moved = F.coalesce(F.col("id") - F.lit(low) + 1, F.lit(0)).cast("long")
    per_shard = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    n = shards * per_shard
    bounds = [] if not rows else splitters(keys.select("k", moved.alias("d"), "size"), n, id_bits, total, int(tolerance * total / shards))
    # The shard of a bucket: that of the target nearest to where the bucket starts.
    starts = [(0, 0, 0), *bounds]
    first_rows: dict[int, int] = {}
    shard_of = []
    for _, below, rows_below in starts:
        shard = min(shards - 1, (2 * below * n // max(1, total) + 1) // 2 // per_shard)
        shard_of.append(shard)
        first_rows.setdefault(shard, rows_below)
    # Look-up by the first bits of the digest: buckets below, and the few bounds inside.
    bits = max(STEP_BITS, (4 * n).bit_length())
    places = [b[0] for b in bounds]
    shift = KEY_BITS + id_bits - bits
    lookup = []
    for prefix in range(1 << bits):
        lower, upper = bisect_right(places, prefix << shift), bisect_right(places, ((prefix + 1) << shift) - 1)
        inside = [(_signed(p >> id_bits) ^ (-1 << 63), p & ((1 << id_bits) - 1)) for p in places[lower:upper]]
        lookup.append((prefix, lower, inside))
    table = spark.createDataFrame(lookup, "prefix long, base int, inside array<struct<k:long,d:long>>")  # 8 n rows or so
    info = spark.createDataFrame(
        [(i, shard_of[i], starts[i][2] - first_rows[shard_of[i]]) for i in range(len(starts))], "bucket int, shard int, before long",
    )
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        digest.alias("k"),
        F.coalesce(number - F.lit(low) + 1, F.lit(0)).cast("long").alias("d"),
    )
    place = F.struct((F.col("k").bitwiseXOR(F.lit(-1 << 63).cast("long"))).alias("k"), F.col("d"))
    placed = (
        keyed.withColumn("prefix", F.shiftrightunsigned("k", KEY_BITS - bits))
        .join(F.broadcast(table), "prefix")
        .withColumn("bucket", F.col("base") + F.size(F.filter("inside", lambda b: b <= place)))
        .join(F.broadcast(info), "bucket")
    )
    order = Window.partitionBy("bucket").orderBy(F.col("k").bitwiseXOR(F.lit(-1 << 63).cast("long")), "d")
    placed = placed.select("row", "shard", (F.col("before") + F.row_number().over(order) - 1).alias("slot"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*kept, "shard", "slot")
