"""Alignment of two tokenizers against the definition, text by text."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest

from marquee.llm import queries, token_align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "   ", "\n", "a ", " a", "a  b", "a\n b \n", "▁x", "ﬁ ① ｘ", "<s> </s> <unk> <|endoftext|> <0x41>", "a\0b", "é è", "中文 中文字 中文", "x" * 5000, "a\x1c b\x85 c d e",
    "  em", "🙂🙂 🙃", "the the the", "ab " * 2000, "\t\ttab", " " * 3000 + "x", "x" + " " * 3000,
]


@pytest.fixture(scope="module")
def aligner():
    return token_align.Aligner(A, B)


def brute(work, text):
    """Groups by the definition over the whole text: lists of (A ids, B ids)."""
    if not text:
        return []
    ids_a, ids_b = work.a.encode(" " + text, add_special_tokens=False).ids, work.b.encode(text)
    letters = token_align.byte_letters()
    parts_a = [bytes(letters[c] for c in work.a.id_to_token(i)) for i in ids_a]
    parts_b = []
    for i in ids_b:
        piece = work.b.id_to_piece(i)
        parts_b.append(bytes([i - 3]) if work.b.is_byte(i) else piece.replace("▁", " ").encode())
    data = (" " + text).encode()
    if b"".join(parts_a) != data or b"".join(parts_b) != data:
        return []
    ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = bisect_right(ends_a, end), bisect_right(ends_b, end)
        out.append((ids_a[i:k], ids_b[j:m]))
        i, j = k, m
    return out


def expected(work, texts):
    """The columns of the query for each text, counts over all of them."""
    groups = [brute(work, t) for t in texts]
    links = [Counter((a, b) for left, right in g for a in left for b in right) for g in groups]
    count = Counter(pair for held in links for pair in held)
    highest = defaultdict(int)
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    rows = []
    for g, held in zip(groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), held.total(), sum(n for (a, b), n in held.items() if count[a, b] == highest[a]),
            sum(n * count[pair] for pair, n in held.items()), hashlib.sha256(text.encode()).hexdigest() if g else "",
        ))
    return rows


def random_texts(n):
    rng = random.Random(12)
    letters = ["a", "b", "The", " ", " ", "\n", "é", "中", "🙂", "▁", "1", "23", ".", "'s", " ", "\x1c", "<s>"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_pieces_align_like_whole_texts(aligner):
    texts = ODD + random_texts(3000)
    for text, groups in zip(texts, aligner.align(texts)):
        whole = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute(aligner, text))
        assert ";".join(g.text for g in groups) == whole, repr(text)
    assert sum(bool(brute(aligner, t)) for t in texts) > 1000


def test_large_groups_are_counted(aligner, monkeypatch):
    texts = ["🙂🙂🙂 🙃 é中", "the x"]
    held = lambda: [{p: n for p, n in zip(*map(list, token_align.held_pairs(groups)))} for groups in aligner.align(texts)]
    plain = held()
    aligner.forget()
    monkeypatch.setattr(token_align, "FEW_LINKS", 0)
    assert held() == plain and all(g.more and not g.links for groups in aligner.align(texts) for g in groups)
    aligner.forget()


def test_generations_of_the_cache(monkeypatch):
    monkeypatch.setattr(token_align, "REMEMBERED", 5)
    work, texts = token_align.Aligner(A, B), random_texts(300)
    out = [";".join(g.text for g in work.align([t])[0]) for t in texts]
    assert out == [";".join(g.text for g in groups) for groups in token_align.Aligner(A, B).align(texts)]


def test_rows_equal_the_definition(spark, aligner, monkeypatch):
    texts = ODD + random_texts(300) + ["the the the"] * 3
    docs = spark.createDataFrame([(i if i % 7 else None, i // 2, t, 5) for i, t in enumerate(texts)], "doc_id long, n long, text string, count int").repartition(3)
    found = token_align.align(docs, A, B, ["doc_id", "n"])
    got = Counter((r.doc_id, r.n, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect())
    assert got == Counter((i if i % 7 else None, i // 2, *row) for i, row in enumerate(expected(aligner, texts)))
    assert token_align.align(docs.limit(0), A, B).count() == 0
    only = token_align.align(docs.where("text is null"), A, B).select("n_a", "n_links", "n_best", "count_sum", "groups_sha256").distinct().collect()
    assert [tuple(r) for r in only] == [(0, 0, 0, 0, "")]


def test_groups_as_text(spark, aligner):
    docs = spark.createDataFrame([(1, "The cat"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r.groups for r in token_align.token_groups(docs, A, B).collect()}
    assert found == {1: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in brute(aligner, "The cat")), 2: ""}


def test_registered_query(spark, aligner):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    wanted = sorted((r.doc_id, *row) for r, row in zip(rows, expected(aligner, [r.text for r in rows])))
    found = queries.op12_token_alignment(spark, folder)
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found.collect()) == wanted
