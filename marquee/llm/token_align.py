"""Alignment of two tokenizers over the same bytes, and how often their ids are linked in the corpus.

Both tokenizers encode a text. The cumulative ends of their tokens are keys of two dictionaries, end to index; the sorted
intersection of the key sets slices both id lists into groups. Every token of the one list in a group is linked to every
token of the other. A pair of ids counts the documents that hold it linked.

A text is encoded and aligned in pieces: no token of either tokenizer crosses a place where white space follows other text,
or, if the second vocabulary has no such token, a mark follows a letter. So groups end there, and a repeated piece is
aligned once. A text with a piece whose bytes a tokenizer doesn't give back is encoded whole, as the definition has it.

First pass: documents are read in segments of bounded bytes, each written as one row with its distinct pairs, how many of
its documents hold each, and per document the places and multiplicities of its pairs. Pairs therefore reach the shuffle
once per segment, not once per document. Counts are summed, the highest of each left id is found, and both go back to the
segments by pair; a pair of all segments is split by the adaptive skew join. Last, each segment meets its own counts.

Defined cases: a text that is null, empty, or not given back by both tokenizers has no tokens, all its numbers are zero
and its digest is the empty string; white space and very long texts without blanks are one piece; repeated rows and ids count
as documents of their own and each keeps its row; of counts that tie all are best; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections import Counter
from collections.abc import Callable, Sequence
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.common import map_texts, slices, worker_cache, written
from marquee.llm.token_counts import balanced

MISSING = object()
REMEMBERED = 50_000
REMEMBERED_CHARS = 64
# A segment, and the pieces encoded and aligned at one time; a chunk is joined to one text for the tokenizers.
SEGMENT_BYTES = 2 << 20
BATCH_BYTES = 1 << 16
CHUNK = 512
# Pairs of a group that are listed one by one; beyond that they are counted.
FEW_LINKS = 64
# Before white space that follows other text, and before a mark that follows a Latin letter.
LETTERS, MARKS, SPACES = "A-Za-zÀ-ÖØ-öø-ɏ", ".,!?;:", " \n\t"
# A piece, from its white space on; letters before a mark end it.
PIECE = re.compile(rf"\s*+(?:[{LETTERS}]++(?![{MARKS}])|[^\s{LETTERS}]++|[^\S{SPACES}]\s*+)*+[{LETTERS}]*+")
PLAIN_PIECE = re.compile(r"\s*+\S++(?:[^\S ]\s*+\S++)*+")
CROSSING = re.compile(rf"[{LETTERS}][{MARKS}]|[\n\t]")
LEAD = " a"  # before pieces that need a letter, or no space, in front of them


def pieces(text: str, cut: Callable[[str], list[str]]) -> list[str]:
    """A space and the text, cut at safe places; white space at the end stays with the last piece."""
    whole = " " + text
    body = whole.rstrip()
    if not body:
        return [whole]
    found = cut(body)
    if not found[-1]:
        found.pop()  # the end of the text
    found[-1] += whole[len(body) :]
    return found


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Group:
    """The alignment of one piece: its tokens in the first list, its groups as text, its links as packed pairs and, from large
    groups, as times per pair."""

    __slots__ = ("n_a", "text", "links", "more")

    def __init__(self, n_a: int, text: str, links: bytes, more: dict[int, int] | None):
        self.n_a, self.text, self.links, self.more = n_a, text, links, more


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = {i: bytes(map(letters.__getitem__, entry)) for entry, i in self.a.get_vocab(False).items()}
        self.bytes_b = [self._piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.sizes_a = np.zeros(max(self.bytes_a, default=0) + 1, np.int64)
        self.sizes_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.sizes_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.names = list(map(str, range(max(len(self.sizes_a), len(self.sizes_b)))))
        # Tokens of the first list never cross these places; whether those of the second do is read from its vocabulary.
        crossing = any(CROSSING.search(self.b.id_to_piece(i)) for i in range(len(self.bytes_b)))
        self.cut = (PLAIN_PIECE if crossing else PIECE).findall
        self.known: dict[str, Group | None] = {}
        self.older: dict[str, Group | None] = {}

    @staticmethod
    def _piece_bytes(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def _gives(self, data: bytes, ids_a: list[int], ids_b: list[int]) -> bool:
        """Whether both lists give the bytes."""
        return b"".join([self.bytes_a.get(i, b"") for i in ids_a]) == data == b"".join([self.bytes_b[i] for i in ids_b])

    def _encode(self, chunks: list[list[str]]) -> dict[str, Group | None]:
        """Pieces by what they are cut to; None for those whose bytes are not given back.

        The pieces of a chunk follow each other as in a text. Those of a chunk that fails are tried one by one.
        """
        parts = [[LEAD, *chain.from_iterable([(p,) if p[0] in SPACES else (LEAD, p) for p in chunk])] for chunk in chunks]
        texts = ["".join(part) for part in parts]
        coded = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        other = self.b.encode([t[1:] for t in texts], num_threads=1)  # it puts a space before a text by itself
        good = [self._gives(t.encode(), a, b) for t, a, b in zip(texts, coded, other)]
        made: dict[str, Group | None] = {}
        found = [list(chain.from_iterable(compress(lists, good))) for lists in (parts, coded, other)]
        made.update(zip(found[0], self._groups([len(p.encode()) for p in found[0]], *found[1:])))
        for chunk, fine in zip(chunks, good):
            if not fine:
                made.update({chunk[0]: None} if len(chunk) == 1 else self._encode([[p] for p in chunk]))
        return made

    def encode(self, wholes: list[str]) -> dict[str, Group | None]:
        """Distinct pieces in chunks; one with white space at its end can't be followed by another."""
        made: dict[str, Group | None] = {}
        for batch in balanced(wholes, BATCH_BYTES):
            plain = [p for p in batch if not p[-1].isspace()]
            made.update(self._encode([*[plain[i : i + CHUNK] for i in range(0, len(plain), CHUNK)], *[[p] for p in batch if p[-1].isspace()]]))
        return made

    def _groups(self, sizes: list[int], ids_a: list[int], ids_b: list[int]) -> list[Group]:
        """Align pieces of ``sizes`` bytes, read as one stream: the end of a piece is an end of both lists."""
        flat_a, flat_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a = dict(zip(np.cumsum(self.sizes_a[flat_a]).tolist(), range(1, len(ids_a) + 1)))
        ends_b = dict(zip(np.cumsum(self.sizes_b[flat_b]).tolist(), range(1, len(ids_b) + 1)))
        common = sorted(ends_a.keys() & ends_b.keys())
        cuts_a, cuts_b = [0, *map(ends_a.__getitem__, common)], [0, *map(ends_b.__getitem__, common)]
        names_a, names_b, join = list(map(self.names.__getitem__, ids_a)), list(map(self.names.__getitem__, ids_b)), ",".join
        texts = [
            f"{names_a[i] if j - i == 1 else join(names_a[i:j])}|{names_b[k] if l - k == 1 else join(names_b[k:l])}"
            for i, j, k, l in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])
        ]
        # Every token of a group with every other: the k-th link of a group takes its row and column from k.
        at_a, at_b = np.array(cuts_a), np.array(cuts_b)
        n_a, n_b = np.diff(at_a), np.diff(at_b)
        n_links = np.where(n_a * n_b <= FEW_LINKS, n_a * n_b, 0)
        offsets = np.concatenate([[0], np.cumsum(n_links)])
        which = np.repeat(np.arange(len(n_links)), n_links)
        k = np.arange(offsets[-1]) - offsets[which]
        links = (flat_a[at_a[which] + k // n_b[which]] << 32 | flat_b[at_b[which] + k % n_b[which]]).astype("<i8").tobytes()
        large = {g: self._times(ids_a[cuts_a[g] : cuts_a[g + 1]], ids_b[cuts_b[g] : cuts_b[g + 1]]) for g in np.flatnonzero(n_links == 0).tolist()}
        edges = np.searchsorted(np.array(common, np.int64), np.cumsum(np.array(sizes, np.int64)), "right")
        out, first, a, at = [], 0, 0, 0
        for last, next_a, end in zip(edges.tolist(), at_a[edges].tolist(), (8 * offsets[edges]).tolist()):
            more = (sum((large[g] for g in range(first, last) if g in large), Counter()) or None) if large else None
            out.append(Group(next_a - a, ";".join(texts[first:last]), links[at:end], more))
            first, a, at = last, next_a, end
        return out

    @staticmethod
    def _times(a: list[int], b: list[int]) -> Counter:
        """Pairs of a large group with their times."""
        others = Counter(b).items()
        return Counter({left << 32 | right: n * m for left, n in Counter(a).items() for right, m in others})

    def align(self, texts: list[str | None]) -> list[list[Group]]:
        """The groups of each text in order, none where it has no tokens."""
        gc.disable()  # nothing here refers to itself, and there are very many small objects
        try:
            return self._align([pieces(t, self.cut) if t else [] for t in texts], texts)
        finally:
            gc.enable()

    def _align(self, cut: list[list[str]], texts: list[str | None]) -> list[list[Group]]:
        # What was used since the last change of generation stays, so frequent pieces are kept.
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        found, new = {}, []
        for piece in set(chain.from_iterable(cut)):
            group = self.known.get(piece, MISSING)
            if group is MISSING:
                group = self.older.get(piece, MISSING)
                if group is MISSING:
                    new.append(piece)
                    continue
                self.known[piece] = group
            found[piece] = group
        made = self.encode(new)
        self.known.update((p, g) for p, g in made.items() if len(p) <= REMEMBERED_CHARS)
        found.update(made)
        out = []
        for text, ps in zip(texts, cut):
            groups = [found[p] for p in ps]
            if None in groups:
                whole = self.encode([" " + text])[" " + text]
                groups = [] if whole is None else [whole]
            out.append(groups)
        return out

    def forget(self) -> None:
        self.known, self.older = {}, {}


def held_pairs(groups: list[Group]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a document, sorted, and how often it holds each."""
    pairs, times = np.unique(np.frombuffer(b"".join([g.links for g in groups]), "<i8"), return_counts=True)
    large = sum((g.more for g in groups if g.more), Counter())
    if large:
        every = Counter(dict(zip(pairs.tolist(), times.tolist()))) + large
        pairs, times = (np.fromiter(values, np.int64, len(every)) for values in (every.keys(), every.values()))
    return pairs, times


def measures(groups: list[Group], times: np.ndarray) -> tuple[int, int, int, int, str]:
    """Tokens of both lists, groups, links and the digest of a document. Groups are joined by semicolons, ids by commas."""
    if not groups:
        return 0, 0, 0, 0, ""
    text = ";".join([g.text for g in groups])
    n_groups, n_a = text.count(";") + 1, sum([g.n_a for g in groups])
    n_b = text.count(",") + 2 * n_groups - n_a
    return n_a, n_b, n_groups, int(times.sum()), hashlib.sha256(text.encode()).hexdigest()


def aligner(path_a: str, path_b: str) -> Aligner:
    return worker_cache(f"align:{path_a}:{path_b}", lambda: Aligner(path_a, path_b))


def token_groups(docs: DataFrame, path_a: str, path_b: str, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and ``groups``, the aligned ids of each text: ``a1,a2|b1;a3|b2,b3``."""

    def make():
        work = aligner(path_a, path_b)
        give = lambda texts: [[";".join(g.text for g in groups) for groups in work.align(texts)]]
        give.done = work.forget
        return give

    return map_texts(docs, keys, F.col(text), "groups string", make)


MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def segments(docs: DataFrame, path_a: str, path_b: str, keys: Sequence[str], text: str) -> DataFrame:
    """A row per segment: its documents with their measures, its distinct pairs with the documents that hold them, and per
    document the places and times of its pairs, one document after the other.

    The number of a segment is only unique within one run, so the rows have to be written before they are joined.
    """
    kept = docs.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__text"))
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" if re.fullmatch(r"\w+", f.name) else f"`{f.name}`: {f.dataType.simpleString()}" for f in kept.schema[:-1])
    document = f"{fields}{', ' if fields else ''}{', '.join(f'{m}: bigint' for m in MEASURES)}, groups_sha256: string, n_pairs: int"
    schema = docs.sparkSession.createDataFrame([], f"segment long, docs array<struct<{document}>>, pairs array<long>, n_docs array<int>, places binary, times binary").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        work, number = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, end in slices(batch.column(len(keys)), SEGMENT_BYTES):
                part = batch.slice(start, end - start)
                rows, codes, times = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for groups in work.align(part.column(len(keys)).to_pylist()):
                    held, n = held_pairs(groups)
                    codes.append(held)
                    times.append(n)
                    rows.append([*measures(groups, n), len(held)])
                pairs, places, n_docs = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
                documents = [part.column(i) for i in range(len(keys))]
                kinds = list(arrow.field("docs").type.value_type)
                documents += [pa.array(column, kind.type) for column, kind in zip(zip(*rows), kinds[len(keys) :])]
                documents = pa.StructArray.from_arrays([d.cast(k.type) for d, k in zip(documents, kinds)], fields=kinds)
                one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kind)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), one(documents, arrow.field("docs").type),
                    one(pa.array(pairs), arrow.field("pairs").type), one(pa.array(n_docs.astype(np.int32)), arrow.field("n_docs").type),
                    pa.array([places.astype("<u4").tobytes()], pa.binary()), pa.array([np.concatenate(times).astype("<i8").tobytes()], pa.binary()),
                ], schema=arrow)
                number += 1
        work.forget()
        pa.default_memory_pool().release_unused()

    return kept.mapInArrow(run, schema)


def pair_counts(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of each segment (segment, place, pair), and of each pair its documents (``count``) and whether no pair of the
    same left id has more (``best``). A left id has no more pairs than the other vocabulary has entries."""
    entries = parts.select("segment", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("place", "entry"))
    entries = entries.select("segment", "place", F.col("entry.pairs").alias("pair"), F.col("entry.n_docs").alias("n"))
    counts = entries.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("left", F.shiftright("pair", 32))
    highest = F.max("count").over(Window.partitionBy("left"))
    return entries.drop("n"), counts.select("pair", "count", (F.col("count") == highest).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of each row."""
    keys = list(keys)
    parts = written(segments(docs, path_a, path_b, keys, text), "segments")
    entries, counts = pair_counts(parts)
    scored = entries.join(counts, "pair").groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("place", "count", "best"))).alias("scores"))
    scored = scored.select("segment", F.col("scores.count").alias("counts"), F.col("scores.best").alias("best"))
    whole = parts.select("segment", "docs", "places", "times").join(scored, "segment", "left").drop("segment")
    results = [*keys, *MEASURES, "groups_sha256"]
    schema = parts.select(F.explode("docs").alias("d")).select(*[F.col(f"d.`{c}`") for c in results]).schema.add("n_best", "long").add("count_sum", "long")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1)
                values = lambda name: part.column(name).flatten().to_numpy(zero_copy_only=False)
                places, times = np.frombuffer(part.column("places")[0].as_py(), "<u4"), np.frombuffer(part.column("times")[0].as_py(), "<i8")
                documents = part.column("docs").flatten()
                fields = dict(zip([f.name for f in documents.type], documents.flatten()))
                ends = np.cumsum(fields["n_pairs"].to_numpy())
                best, total = (np.concatenate([[0], np.cumsum(values(name)[places].astype(np.int64) * times)]) if len(places) else np.zeros(1, np.int64) for name in ("best", "counts"))
                starts = ends - fields["n_pairs"].to_numpy()
                sums = [pa.array(np.asarray(s[ends] - s[starts], np.int64)) for s in (best, total)]
                yield pa.RecordBatch.from_arrays([*[fields[c] for c in results], *sums], schema=arrow)

    return whole.mapInArrow(run, schema)
