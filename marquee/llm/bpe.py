"""Byte-level BPE with a public rank file: encoding by backtracking over longest matches, and decoding.

The bytes of a piece are read as Latin-1 characters, so an Aho-Corasick automaton over all tokens finds the longest
token at each place. A sequence of tokens is what the merges produce exactly if every adjacent pair of tokens is: two
tokens are compatible if merging their joined bytes gives these two back. The encoder takes the longest token that is
compatible with the one before, steps back when none is, and never visits a dead end twice, so its steps are
linear in the length of the piece. Compatibility of pairs is remembered.

Each match of the splitting pattern is encoded separately, without special tokens. Null counts as empty; ids may be
null or repeated; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence
from struct import pack

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import map_texts, worker_cache
from marquee.llm.token_counts import pieces

REMEMBERED = 150_000
REMEMBERED_MATCHES = 300_000
REMEMBERED_PAIRS = 300_000
REMEMBERED_CHARS = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        # The reference splitter's \s is the Unicode property White_Space.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.bytes = {rank: token for token, rank in ranks.items()}
        # Read from right to left, an occurrence ends where the token starts; the longest one is reported.
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token[::-1], rank)
        self.automaton.make_automaton()
        self.sizes = {rank: len(token) for token, rank in self.ranks.items()}
        self.shorter: dict[int, int | None] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}  # of pieces, and of the pattern's matches in them
        self.matches: dict[str, bytes] = {}

    def prefix(self, token: int) -> int | None:
        """The longest other token that this one starts with."""
        found = self.shorter.get(token, -1)
        if found == -1:
            text = self.tokens[token]
            found = next((r for n in range(len(text) - 1, 0, -1) if (r := self.ranks.get(text[:n])) is not None), None)
            self.shorter[token] = found
        return found

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, none for a single byte."""
        if token not in self.parts:
            self.parts[token] = self._merge_apart(self.tokens[token], token)
        return self.parts[token]

    def _merge_apart(self, text: str, rank: int) -> tuple[int, int] | None:
        """Merge the bytes of a token by ranks below its own; two parts are left."""
        parts = list(text)
        while len(parts) > 2:
            best, at = min((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined bytes of two tokens merge to exactly these two.

        Undo merges on both sides of the seam, the later merge first. A token across the seam that would have been
        merged before the pieces beside it were used up shows that the pair can't occur.
        """
        pair = (left, right)
        known = self.fits.get(pair)
        if known is None:
            known = self.fits[pair] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        tokens, ranks, limit = self.tokens, self.ranks, len(self.ranks)
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:  # of equal merges the left one comes first, so one across the seam goes before this
                limit, right = right + 1, b[0]

    def encode_piece(self, text: str) -> list[int]:
        """Ids of one match of the pattern, given as Latin-1 characters."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        n, sizes, fits, shorter = len(text), self.sizes, self.fits.get, self.prefix
        longest: list[int | None] = [None] * n
        for end, rank in self.automaton.iter(text[::-1]):  # per place, longer tokens come first
            if longest[n - 1 - end] is None:
                longest[n - 1 - end] = rank
        dead = bytearray(n + 1)
        out: list[int] = []
        before, place, token = None, 0, longest[0]
        while place < n:
            while token is not None:
                after = place + sizes[token]
                if not dead[after]:
                    if before is None:
                        break
                    fit = fits((before, token))
                    if fit or (fit is None and self.compatible(before, token)):
                        break
                token = shorter(token)
            if token is not None:
                out.append(token)
                before, place = token, after
                token = longest[place] if place < n else None
            elif out:
                dead[place] = 1
                last = out.pop()
                before = out[-1] if out else None
                place -= sizes[last]
                token = shorter(last)
            else:
                raise ValueError("the ranks lack a byte of the text")
        return out

    def packed(self, piece: str) -> bytes:
        """Ids of a piece of text, as little-endian unsigned 32-bit integers."""
        known, out = self.matches, []
        for part in self.split(piece):
            ids = known.get(part)
            if ids is None:
                found = self.encode_piece(part.encode().decode("latin-1"))
                ids = pack(f"<{len(found)}I", *found)
                if len(part) <= REMEMBERED_CHARS:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, packed. Places before white space never lie inside a match, so pieces repeat."""
        known, out = self.known, []
        if len(known) > REMEMBERED:
            known.clear()
        if len(self.matches) > REMEMBERED_MATCHES:
            self.matches.clear()
        if len(self.fits) > REMEMBERED_PAIRS:
            self.fits.clear()
        for piece in pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = self.packed(piece)
                if len(piece) <= REMEMBERED_CHARS:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def forget(self) -> None:
        self.known.clear()
        self.matches.clear()

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def _task(bpe: Bpe, work):
    """The work of a task, which forgets its pieces at the end; the vocabulary stays in the worker."""
    work.done = bpe.forget
    return work


def tokenizer(path: str, pattern: str) -> Bpe:
    """The tokenizer of a rank file, built once in each Python worker."""
    return worker_cache(f"bpe:{path}:{pattern}", lambda: Bpe(read_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and ``ids``, the packed ids of each text."""

    def make():
        bpe = tokenizer(path, pattern)
        return _task(bpe, lambda texts: [[bpe.encode(t) if t else b"" for t in texts]])

    return map_texts(docs, keys, F.col(text), "ids binary", make)


def decode(encoded: DataFrame, path: str, pattern: str, keys: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keys`` and ``decoded``, the bytes that packed ids stand for; null ids give none."""

    def make():
        bpe = tokenizer(path, pattern)
        return lambda packed: [[bpe.decode(np.frombuffer(p or b"", "<u4").tolist()) for p in packed]]

    return map_texts(encoded, keys, F.col(ids), "decoded binary", make)


def encode_and_decode(docs: DataFrame, path: str, pattern: str, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, ``ids`` and ``decoded`` in one pass, with one tokenizer in memory."""

    def make():
        bpe = tokenizer(path, pattern)

        def work(texts):
            ids = [bpe.encode(t) if t else b"" for t in texts]
            return [ids, [bpe.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]]

        return _task(bpe, work)

    return map_texts(docs, keys, F.col(text), "ids binary, decoded binary", make)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_tokens, digests of the packed ids and of the bytes decoded from them."""

    def make():
        bpe = tokenizer(path, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()

        def work(texts):
            ids = [bpe.encode(t) if t else b"" for t in texts]
            return [[len(i) // 4 for i in ids], [sha(i) for i in ids], [sha(bpe.decode(np.frombuffer(i, "<u4").tolist())) for i in ids]]

        return _task(bpe, work)

    return map_texts(docs, [key], F.col(text), "n_tokens long, ids_sha256 string, decoded_sha256 string", make)
