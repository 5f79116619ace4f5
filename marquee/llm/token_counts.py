"""Token counts of whole texts by a public tokenizer, lengths only.

Texts are cut at safe boundaries, where white space follows other text: a byte-level tokenizer's pattern never
matches across such a place, so counts of the pieces add up. Distinct pieces are encoded in batches of about equal bytes
and remembered, and only lengths leave the library. A text with a separator that Python and the tokenizer class
differently (U+001C to U+001F) is encoded in one piece. Null counts as empty; ids may be null or repeated; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import map_texts, worker_cache

BATCH_BYTES = 1 << 20
REMEMBERED = 500_000
REMEMBERED_CHARS = 64
PIECE = re.compile(r"\s+\S*|\S+")
ODD_SEPARATORS = "\x1c\x1d\x1e\x1f"


def pieces(text: str) -> list[str]:
    """The text cut before every run of white space that follows other text."""
    return [text] if any(c in text for c in ODD_SEPARATORS) else PIECE.findall(text)


def balanced(items: list[str], limit: int = BATCH_BYTES):
    """Batches of about ``limit`` characters; a longer item comes alone."""
    batch, held = [], 0
    for item in items:
        if batch and held + len(item) > limit:
            yield batch
            batch, held = [], 0
        batch.append(item)
        held += len(item)
    if batch:
        yield batch


class Counter:
    """Counts tokens with the file ``path``; keeps the counts of short pieces."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def count(self, texts: list[str | None]) -> list[int]:
        cut = [pieces(text) if text else [] for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        counts = self.known
        new = list({p for ps in cut for p in ps if p not in counts})
        long = {}
        for batch in balanced(new):
            for piece, coded in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                (counts if len(piece) <= REMEMBERED_CHARS else long)[piece] = len(coded)
        if long:
            counts = {**counts, **long}
        return [sum(map(counts.__getitem__, ps)) for ps in cut]


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row."""

    def make():
        counter = worker_cache(f"tokens:{path}", lambda: Counter(path))
        return lambda texts: [[len(t.encode()) if t else 0 for t in texts], counter.count(texts)]

    return map_texts(docs, [key], F.col(text), "n_bytes long, n_tokens long", make).withColumn("over_limit", F.col("n_tokens") > limit)
