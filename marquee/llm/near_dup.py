"""Near duplicates: a multi-index Hamming join of b-bit MinHash signatures, confirmed on full shingle sets.

A signature has ``CHUNKS`` chunks of ``WIDTH`` values of 16 bits. Two signatures that differ in at most
``CHUNKS * (ERRORS + 1) - 1`` values have a chunk with at most ``ERRORS`` differences, by the pigeonhole principle. So
every chunk is entered once for each choice of ``ERRORS`` places left out, and all pairs under that distance share an
entry. At similarity 0.8 a pair differs in a value with probability 0.2, and shares no entry at all with probability
0.345^10, about 2 in 100,000; above that much less.

Documents with the same shingle set are one class first; only class representatives (least ids) enter the index. An entry
whose members agree in the place left out as well is dropped, as they all meet in the first entry of that chunk. Members
of an entry are compared with one of them, its hub, so an entry of n members gives n - 1 pairs; each chunk orders ids
differently, so a member of a large group meets several hubs. Pairs whose signatures differ
too much are dropped; the others are confirmed on the full sets, the nearest per member first, the rest only where the
ends are not yet connected. What this star leaves, members of one entry in different components, is compared in blocks:
by signatures, which marks the members that have a near partner elsewhere and names the nearest; nearest partners are
confirmed; then, with the texts of the marked members in the blocks, all that is still apart. Only links leave the
blocks. So no link between components is missed, and no group is expanded into all its pairs.

Defined cases: null and empty texts have no shingles and no links; rows with a null id are never linked and stay; rows
that share an id share its fate; an empty table gives no rows; further columns do not matter.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import SLICE_BYTES, map_texts, shuffled, text_bytes, written
from marquee.llm.components import components

CHUNKS, WIDTH, ERRORS = 10, 6, 1
VALUES = CHUNKS * WIDTH
GUARANTEED = CHUNKS * (ERRORS + 1) - 1
# Five standard deviations above the mean distance of a pair at similarity 0.8 (12 of 60 values).
NEAR = 27
BLOCK = 256
# Work of a task: comparisons of signatures, a member counting as MEMBER of them; pairs of texts. Shuffles of less work
# than partitions are read by fewer tasks, TASKS per core at least, so that small graphs do not wait for idle ones.
COMPARED, MEMBER, CONFIRMED, TASKS = 1 << 18, 64, 1 << 10, 4
# Chosen ids are marked in a bitmap that filters texts before they move: 16 bits each, within these bounds (64 MB).
BITMAP_BITS = 1 << 20, 1 << 29
_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(0, 2**64, VALUES, np.uint64) | np.uint64(1)
OFFSETS = _RNG.integers(0, 2**64, VALUES, np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
PART = 1 << 14
# Per chunk: ids are ordered by their bits XOR this number, which picks another hub for each chunk.
MASKS = [int(x) for x in _RNG.integers(0, 2**62, CHUNKS)]


class _Words(dict):
    """Digests of words, bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        digest = self[word] = xxhash.xxh64_intdigest(word)
        return digest


def shingles(data: bytes, size: int, known: _Words) -> np.ndarray:
    """Sorted distinct digests of the windows of ``size`` words; of the whole sequence if it is shorter."""
    words = data.lower().split()  # bytes: lowers A-Z only, splits at blanks, tabs and line ends of ASCII
    if not words:
        return np.empty(0, np.uint64)
    digests = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(words) - size + 1
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ digests[i : i + n]) * MIX
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(found: np.ndarray) -> np.ndarray:
    """The low 16 bits, above the lowest, of the least value under each hash function."""
    least = np.full(VALUES, 2**64 - 1, np.uint64)
    for start in range(0, len(found), PART):
        values = found[None, start : start + PART] * FACTORS[:, None]
        values += OFFSETS[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(20)).astype(np.uint16).view(np.int16)


def signatures(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, ``digest`` of the set and ``sig``; both null without shingles."""

    def make():
        import xxhash

        known = _Words()

        def work(texts):
            counts, digests, sigs = [], [], []
            for data in texts:
                found = shingles(data, size, known)
                counts.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                sigs.append(signature(found) if len(found) else None)
            return [counts, digests, pa.array(sigs, pa.list_(pa.int16()))]

        return work

    return map_texts(docs, [key], text_bytes(text), "n_shingles long, digest binary, sig array<smallint>", make)


def _entries(sig: Column) -> Column:
    """One entry per chunk and place left out: its number, its hash and the value left out."""
    made = []
    for chunk in range(CHUNKS):
        for number, left in enumerate(combinations(range(WIDTH), WIDTH - ERRORS)):
            entry = F.xxhash64(F.lit(chunk * 100 + number), *[sig[chunk * WIDTH + i] for i in left])
            made.append(F.struct(entry.alias("entry"), sig[chunk * WIDTH + WIDTH - 1 - number].alias("out")))
    return F.posexplode(F.array(*made))


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, x: acc + x)


def _texts(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """Texts of the documents whose ids are in ``nodes``.

    A bitmap of the ids, bounded in size, is broadcast and drops most other texts where they are read. What passes is
    joined; with far more ids than bits everything passes, which costs a shuffle but changes no row.
    """
    nodes = nodes.select("id").distinct()
    least, most = BITMAP_BITS
    n = nodes.count()
    bits = min(most, max(least, 1 << (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    marks = nodes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("marks"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substr("marks", (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    likely = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "bucket").where(F.getbit(byte, (position % 8).cast("int")) == 1)
    return likely.select("id", text_bytes("text").alias("data")).join(shuffled(nodes, n), "id", "left_semi")


def similar(first: np.ndarray, second: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(first), len(second)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(first, second, assume_unique=True))
    return both > 0 and 100 * both >= percent * (small + large - both)


def _tasks(df: DataFrame, work: int, most: int, texts: DataFrame | None = None, rows: int = 0) -> int:
    """Tasks that do no more than ``most`` of the work each and see no more than ``SLICE_BYTES`` of texts, at their mean size."""
    seen = rows * (texts.agg(F.avg(F.octet_length("data"))).first()[0] or 0) if texts is not None else 0
    return max(TASKS * df.sparkSession.sparkContext.defaultParallelism, -(-work // most), int(seen // SLICE_BYTES) + 1)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int, rows: int) -> DataFrame:
    """The pairs (a, b), ``rows`` at most, whose full shingle sets are similar enough; again for each text of an id."""
    left = texts.select(F.col("id").alias("a"), F.col("data").alias("data_a"))
    right = texts.select(F.col("id").alias("b"), F.col("data").alias("data_b"))
    joined = pairs.select("a", "b").join(shuffled(right), "b").join(shuffled(left), "a").coalesce(_tasks(pairs, rows, CONFIRMED, texts, 2 * rows))

    def run(batches):
        known, last, first = _Words(), None, None
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                one = batch.column(2)[i].as_py()
                if one != last:  # rows with one a lie together after the join
                    last, first = one, shingles(one, size, known)
                keep.append(similar(first, shingles(batch.column(3)[i].as_py(), size, known), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("a", "b", "data_a", "data_b").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """Pairs whose ends are in different components. There are ``rows`` links at most in ``groups``."""
    for side in ("a", "b"):
        own = groups.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}"))
        pairs = pairs.join(shuffled(own, rows), side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    return pairs.where("of_a <> of_b").drop("of_a", "of_b")


def _mixed(members: DataFrame, groups: DataFrame, links: int) -> DataFrame:
    """Members (entry, number, id, of) of the entries that hold several components beside their hub."""
    rows = members.where("n > 2").join(shuffled(groups.withColumnRenamed("component", "of"), links), "id", "left").withColumn("of", F.coalesce("of", "id"))
    rows = rows.where("id <> hub")  # the hub has met all others
    mixed = rows.groupBy("entry").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high")
    return rows.join(mixed, "entry", "left_semi").select("entry", "number", "id", "of")


def _attached(placed: DataFrame, known: DataFrame) -> DataFrame:
    """Members with what is known of their ids, joined once per id: its entries, ``VALUES`` at most, meanwhile are a list."""
    entries = F.collect_list(F.struct(*[c for c in placed.columns if c not in ("id", "of")])).alias("entries")
    return placed.groupBy("id").agg(F.first("of").alias("of"), entries).join(shuffled(known), "id").select(*known.columns, "of", F.inline("entries"))


def _meetings(mixed: DataFrame, reps: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Blocks of members to compare: entry and its number, rows of one side, rows of the other.

    In each entry the members of the largest component form blocks on one side only, the others blocks on both. An entry
    of no more than a block's rows is gathered as it is; in larger ones the largest component and the others are cut into as
    many blocks as each needs, and the blocks joined.
    """
    main = mixed.groupBy("entry", "of").agg(F.count("*").alias("n")).groupBy("entry").agg(F.max_by("of", F.struct("n", "of")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    known = reps.select("id", "sig")
    if texts is not None:
        known = known.join(shuffled(texts), "id")
    row = F.struct(*known.columns, "of")
    rest = F.col("of") != F.col("main")
    placed = mixed.join(main, "entry")
    whole = _attached(placed.where(F.col("n") <= BLOCK), known).groupBy("entry", "number").agg(
        F.collect_list(F.when(rest, row)).alias("rows_a"), F.collect_list(row).alias("rows_b"),
    )
    work, rows, most = main.agg(F.sum(F.col("n") * (MEMBER + F.col("n") - F.col("n_main"))), F.sum("n"), F.max("n")).first()
    few = _tasks(mixed, work or 0, COMPARED, texts, rows or 0)
    if (most or 0) <= BLOCK:
        return whole.coalesce(few)
    blocks = (
        _attached(placed.where(F.col("n") > BLOCK), known).withColumn("rest", rest)
        .withColumn("blocks", F.ceil(F.when(F.col("rest"), F.col("n") - F.col("n_main")).otherwise(F.col("n_main")) / BLOCK).cast("long"))
        .withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        .groupBy("entry", "number", "rest", "block").agg(F.collect_list(row).alias("rows"))
    )
    left = blocks.where("rest").select("entry", "number", F.col("block").alias("block_a"), F.col("rows").alias("rows_a"))
    right = blocks.select("entry", F.col("rest").alias("rest_b"), F.col("block").alias("block_b"), F.col("rows").alias("rows_b"))
    met = left.join(right, "entry").where("not rest_b or block_a <= block_b")
    return whole.unionByName(met.select("entry", "number", "rows_a", "rows_b")).coalesce(few)


def first_shared(equal: np.ndarray) -> np.ndarray:
    """Number of the first entry that signatures share, from rows of which values are equal (there must be one)."""
    errors = ~equal.reshape(len(equal), CHUNKS, WIDTH)
    few = errors.sum(axis=2) <= ERRORS
    chunk = few.argmax(axis=1)
    places = errors[np.arange(len(equal)), chunk]
    # Choices come in the order of ``combinations``: the first leaves out the last place.
    return chunk * WIDTH + np.where(places.any(axis=1), WIDTH - 1 - places.argmax(axis=1), 0)


class _Side(NamedTuple):
    """One side of a block, a value or a row of values per member."""

    ids: np.ndarray
    of: np.ndarray
    sigs: np.ndarray
    data: pa.Array | None


def _side(rows: pa.ListArray) -> list[_Side]:
    """Sides of the blocks of a batch, cut out of its columns without a Python object per value."""
    members = rows.flatten()
    names = [f.name for f in members.type]
    ids, of = (members.field(names.index(n)).to_numpy(zero_copy_only=False) for n in ("id", "of"))
    sigs = members.field(names.index("sig")).flatten().to_numpy(zero_copy_only=False).reshape(-1, VALUES)
    data = members.field(names.index("data")) if "data" in names else None
    ends = np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    return [_Side(ids[i:j], of[i:j], sigs[i:j], None if data is None else data.slice(i, j - i)) for i, j in zip([0, *ends], ends)]


def _sides(batch: pa.RecordBatch):
    """Blocks of a batch: entry, its number, one side, the other."""
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _side(batch.column(2)), _side(batch.column(3)))


def _partners(one: _Side, i: int, two: _Side, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``two`` of members near to member ``i``, in other components, that share this entry first; their distances."""
    equal = two.sigs == one.sigs[i]
    far = VALUES - np.count_nonzero(equal, axis=1)
    at = np.flatnonzero((far <= NEAR) & (two.of != one.of[i]))
    if len(at):
        at = at[first_shared(equal[at]) == number]
    return at, far[at]


def _marked(meetings: DataFrame) -> DataFrame:
    """Members with a near partner in another component: entry, id, the nearest partner and its distance (one side only)."""

    def run(batches):
        for batch in batches:
            out = []
            for entry, number, one, two in _sides(batch):
                hit = set()
                for i in range(len(one.ids)):
                    at, far = _partners(one, i, two, number)
                    if len(at):
                        hit.update(at.tolist())
                        out.append((entry, int(one.ids[i]), int(two.ids[at[far.argmin()]]), int(far.min())))
                out += [(entry, int(two.ids[k]), None, None) for k in sorted(hit)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["entry", "id", "other", "far"])

    return meetings.mapInArrow(run, "entry long, id long, other long, far long")


def _links(meetings: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components inside blocks, by full sets; twice at most."""

    def run(batches):
        known = _Words()
        for batch in batches:
            out_a, out_b = [], []
            for _, number, one, two in _sides(batch):
                sets = {}
                for i in range(len(one.ids)):
                    at, _ = _partners(one, i, two, number)
                    mine = shingles(one.data[i].as_py(), size, known) if len(at) else None
                    for k in at.tolist():
                        if k not in sets:
                            sets[k] = shingles(two.data[k].as_py(), size, known)
                        if similar(mine, sets[k], percent):
                            out_a.append(int(one.ids[i]))
                            out_b.append(int(two.ids[k]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["x", "y"])

    found = meetings.mapInArrow(run, "x long, y long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links. Each node's link to the least of its component stands for all links found before."""
    return components(groups.select(F.col("component").alias("a"), F.col("id").alias("b")).unionAll(links))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_shingles, component_id (least id reached) and kept, one row per document."""
    sigs = written(signatures(docs, size, key, text).withColumn("id", F.col(key).cast("long")), "near-sigs")
    classes = sigs.where("digest is not null and id is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("size"),
    )
    classes = written(classes, "near-classes")
    reps = classes.select(F.col("rep").alias("id"), "sig", "size")
    index = reps.select("id", _entries(F.col("sig")).alias("number", "of")).select("id", "number", "of.entry", "of.out")
    mask = F.element_at(F.array(*[F.lit(m) for m in MASKS]), (F.col("number") / WIDTH).cast("int") + 1)
    hubs = index.groupBy("entry", "number").agg(F.min(F.col("id").bitwiseXOR(mask)).alias("hub"), F.count("*").alias("n"), F.min("out").alias("low"), F.max("out").alias("high"))
    # Where the value left out is the same too, all members share the whole chunk and meet in its first entry.
    hubs = hubs.where((F.col("n") > 1) & ((F.col("low") != F.col("high")) | (F.col("number") % WIDTH == 0)))
    hubs = hubs.select("entry", F.col("hub").bitwiseXOR(mask).alias("hub"), "n")
    members = written(index.drop("out").join(shuffled(hubs), "entry"), "near-members")
    pairs = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    for side in ("a", "b"):
        own = reps.select(F.col("id").alias(side), F.col("sig").alias(f"sig_{side}"), F.col("size").alias(f"size_{side}"))
        pairs = pairs.join(shuffled(own), side)
    pairs = pairs.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))
    pairs = written(pairs.select("a", "b", _distance("sig_a", "sig_b").alias("far")).where(F.col("far") <= NEAR), "near-pairs")

    groups, rows = None, pairs.count()
    if rows:
        texts = written(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")), key, text), "near-texts")
        nearest = pairs.groupBy("b").agg(F.min(F.struct("far", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
        groups = components(written(confirm(nearest, texts, size, percent, rows), "near-links"))
        rest = written(_apart(pairs.join(shuffled(nearest, rows), ["a", "b"], "left_anti"), groups, rows).select("a", "b"), "near-rest")
        if not rest.isEmpty():
            groups = _joined(groups, written(confirm(rest, texts, size, percent, rows), "near-links"))
        mixed = written(_mixed(members, groups, rows), "near-mixed")
        marked = written(_marked(_meetings(mixed, reps, None)), "near-marked")
        found = marked.count()
        if found:
            texts = written(_texts(docs, marked, key, text), "near-texts")
            closest = marked.where("other is not null").groupBy("id").agg(F.min(F.struct("far", "other")).alias("best"))
            closest = closest.select(F.least("id", "best.other").alias("a"), F.greatest("id", "best.other").alias("b")).distinct()
            groups = _joined(groups, written(confirm(closest, texts, size, percent, found), "near-links"))
            mixed = _mixed(members, groups, rows + found).join(shuffled(marked.select("entry", "id").distinct(), found), ["entry", "id"], "left_semi")
            mixed = written(mixed, "near-mixed")
            links = written(_links(_meetings(mixed, reps, texts), size, percent), "near-links")
            if not links.isEmpty():
                groups = _joined(groups, links)
    named = classes.select("digest", "rep")
    if groups is not None:
        named = named.join(shuffled(groups.withColumnRenamed("id", "rep")), "rep", "left")
        named = named.select("digest", F.coalesce("component", "rep").alias("component"))
    else:
        named = named.withColumnRenamed("rep", "component")
    found = sigs.select(F.col(key), "id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "id"))
    return found.select(key, "n_shingles", own.alias("component_id"), (F.col("id").isNull() | (F.col("id") == own)).alias("kept"))
