"""Text operators against brute-force versions, and their defined odd cases."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marquee.llm import bpe, decontaminate, html_text, pii, quality, sharding, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t", "one", "one two", "x" * 50_000, "Été naïve – 中文 text 中文 text.", "a b " * 3000, "tab\tand nbsp 　 wide", "a\x1cb \x1d c"]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---------------------------------------------------------------- quality


def brute_measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(lines), text.count("!"), sum(a == b for a, b in zip(words, words[1:])),
    )


def test_measures_equal_brute_force():
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab \n!#\x0b é") for _ in range(rng.randrange(80))) for _ in range(500)]
    for text in texts:
        assert quality.measure(text) == brute_measures(text), repr(text)


def test_ledger_policies_and_ablation(spark):
    texts = ["word " * 3, " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}#" for i in range(30)), "a b c d e f " * 10, None]
    entries = quality.ledger(docs_of(spark, texts)).cache()
    kept = {r.doc_id: r.ok for r in entries.select("doc_id", quality.passes("v1").alias("ok")).collect()}
    assert kept == {0: False, 1: True, 2: False, 3: False, 4: False}
    loose = {r.doc_id: r.ok for r in entries.select("doc_id", quality.passes("base").alias("ok")).collect()}
    assert loose[2]
    found = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablation(entries, "v1").collect()}
    assert found["few_words"][0] == 2 and found["symbols"] == (1, 1, 2)
    assert set(found) == set(quality.POLICIES["v1"])


def test_ledger_of_empty_table_and_clashing_columns(spark):
    df = docs_of(spark, ["one two"]).withColumn("failed", F.lit("mine")).withColumn("n_words", F.lit("mine"))
    assert quality.ledger(df).first().n_words == 2
    assert quality.ledger(df.where("false")).count() == 0


# ---------------------------------------------------------------- sharding


def check_shards(spark, texts, shards=4, ids=None):
    rows = [((ids[i] if ids else i), t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    found = sharding.histogram_sort(df, shards).select("*", sharding.size_of("text").alias("size")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in found) == sorted((a is not None, a or 0, b or "") for a, b, _ in rows)
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < shards for s in slots)
    return found


def test_shards_hold_equal_bytes(spark):
    rng = random.Random(1)
    texts = ["é" * rng.randrange(60) for _ in range(1500)] + ["the same copy"] * 700 + [None, "", "x" * 3000]
    found = check_shards(spark, texts)
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 4
    assert all(abs(s - mean) <= 3016 + 0.01 * mean for s in sizes.values())


def test_shards_of_odd_inputs(spark):
    check_shards(spark, ["tie"] * 50, ids=[7] * 50)
    check_shards(spark, ["a", None, "b", ""], ids=[None, None, 2**62, -(2**62)])
    check_shards(spark, ["only"], shards=40)
    assert sharding.histogram_sort(docs_of(spark, []), 40).count() == 0


def test_equal_texts_lie_side_by_side(spark):
    found = check_shards(spark, [f"t{i % 50}" for i in range(500)], shards=2)
    order = [r.text for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    runs = sum(a != b for a, b in zip(order, order[1:])) + 1
    assert runs <= 52


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def tokenizers_path():
    return pytest.importorskip("public_tokenizers").path


def fuzz(n, seed=2):
    rng = random.Random(seed)
    alphabets = ["ab \n", "the an 's\t", " \n\r\x0b\x85  x!", "aé中\x1c\x1d!.' 9", [chr(c) for c in range(32, 0x3000)], ["<|endoftext|>", " ", "a", "\n"]]
    return ["".join(rng.choice(a) for _ in range(rng.randrange(60))) for a in alphabets for _ in range(n)]


def test_token_counts_equal_the_library(spark, tokenizers_path):
    from tokenizers import Tokenizer

    path = tokenizers_path("byte_bpe_50k.json")
    texts = ODD + fuzz(100)
    got = by_id(token_counts.token_counts(docs_of(spark, texts), path))
    library = Tokenizer.from_file(path)
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 512), repr(text)[:80]


def test_batches_are_balanced():
    batches = list(token_counts.balanced(["x" * 10] * 25 + ["y" * 1000], 100))
    assert [len(b) for b in batches] == [10, 10, 5, 1]


def test_bpe_equals_tiktoken_and_round_trips(spark, tokenizers_path):
    import numpy as np
    import public_tokenizers as public
    import tiktoken

    path = tokenizers_path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [t for t in ODD if not t or len(t) < 20_000] + fuzz(200, seed=5) + ["a" * 3000, "ab" * 1500]
    df = docs_of(spark, texts)
    got = by_id(bpe.round_trip(df, path, public.PATTERN))
    ids = by_id(bpe.encode(df, path, public.PATTERN))
    back = by_id(bpe.decode(bpe.encode(df, path, public.PATTERN), path, public.PATTERN))
    for i, text in enumerate(texts):
        want = library.encode_ordinary(text or "")
        packed = np.array(want, "<u4").tobytes()
        assert bytes(ids[i].ids) == packed, repr(text)[:80]
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(want), hashlib.sha256(packed).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert bytes(back[i].decoded).decode() == (text or "")


# ---------------------------------------------------------------- pages

FILLER = "Some running text of the article, long enough to count. "
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>{FILLER * 3}<p>Short.<br>After &lt;break&gt;&nbsp;here<div class="ad">Buy</div><p>Last <b>bold</b>
   words</article><aside>Side</aside><section id="comments"><article class="comment"><p>{FILLER * 9}</p></article></section>
<form><label>Mail</label></form><footer>&copy; me</footer></body></html>"""


def test_main_text_of_an_article():
    want = ["Head & line", (FILLER * 3).strip(), "Short. After <break> here", "Last bold words"]
    assert html_text.main_text(PAGE) == "\n".join(want)


def test_main_text_without_article_element():
    page = f"<body><div id=menu><a href=1>One</a></div><p><a href=2>Link list</a></p><div>{FILLER * 5}</div><p>{FILLER}</p><footer>f</footer>"
    assert html_text.main_text(page) == (FILLER * 5).strip() + "\n" + FILLER.strip()


def test_extract_odd_pages(spark):
    pages = [(0, None, None), (1, "u", ""), (2, "u", "plain text only"), (3, "u", "<nav>unclosed <p>text " + FILLER), (3, "u", "<p>" * 2000 + "deep")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = html_text.extract(df).collect()
    assert sorted((r.page_id, r.n_chars == len(r.text)) for r in rows) == [(i, True) for i in (0, 1, 2, 3, 3)]
    assert {r.page_id: r.text for r in rows if r.page_id < 3} == {0: "", 1: "", 2: "plain text only"}
    assert html_text.extract(df.where("false")).count() == 0


def test_stretches_split_at_wide_gaps_only():
    assert [(s, e) for s, e, _ in html_text.stretches([0, 0, 0, 5, 0, 5, 0, 0, 0, 7])] == [(1, 6), (7, 10)]


def test_surge_and_dive_points_choose_lines_on_pages_with_articles():
    links = "".join(f"<li><a href={i}>Link number {i}</a></li>" for i in range(4))
    body = f"<div><p>{FILLER * 5}</p><p>{FILLER}</p></div>"
    teaser = "<article>Teaser</article>"
    assert html_text.main_text(f"<ul>{links}</ul>{teaser}<ul>{links}</ul>{body}") == (FILLER * 5).strip() + "\n" + FILLER.strip()
    assert html_text.main_text(f"{teaser}{body}") == "Teaser\n" + (FILLER * 5).strip() + "\n" + FILLER.strip()


def test_no_text_is_cut_by_shares_or_furniture():
    long, short = "x" * 600, "y" * 120
    advert = '<div class="ad">Buy</div>'
    assert html_text.main_text(f"<div>{long}</div>{advert}<p>{short}</p>{advert}<p>End.</p>").split("\n") == [long, short, "End."]
    assert html_text.main_text(f"<article>{short}</article><article>{long}</article><article>{short}</article>").split("\n") == [short, long, short]
    assert html_text.main_text(f"<div>{long}</div><p><a href=1>All of it a link</a></p><div>{short}</div>").split("\n") == [long, "All of it a link", short]
    mixed = "In this paragraph links have most characters, but the rest is prose. "
    page = f"<div>{long}</div><p>{mixed}<a href=1>{'l' * 300}</a></p>"
    assert html_text.main_text(page).split("\n") == [long, mixed + "l" * 300]


# ---------------------------------------------------------------- benchmark passages


def brute_hits(text, items, size=10):
    fold = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, found = fold(text), set(), set()
    for item, body in items:
        ws = fold(body)
        k = min(size, len(ws))
        windows = {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if ws else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [16 << 20, 120])
def test_passages_equal_brute_force(spark, block_bytes):
    rng = random.Random(9)
    word = lambda: rng.choice(["ab", "b", "Cé", "d1", "ee"])
    items = [(i % 9, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 14])))) for i in range(12)] + [(None, "Zz yy xx"), (50, None)]
    texts = ODD + [", ".join(word() for _ in range(rng.randrange(40))) for _ in range(60)] + [items[3][1] + "! " + items[5][1], "so ZZ, yy; xx. end"] * 2
    df = docs_of(spark, texts).withColumn("hits", F.lit(1))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.find(df, benchmark, block_bytes=block_bytes))
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        n_words, n_hit, found = brute_hits(text, items)
        assert (got[i].n_words, got[i].n_hit, got[i]["items"], got[i].contaminated) == (n_words, n_hit, found, n_hit > 0), repr(text)[:80]


def test_passages_with_empty_tables(spark):
    df, none = docs_of(spark, ["a b", "a b"]), spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.find(df, none).collect()] == [0, 0]
    assert decontaminate.find(df.where("false"), none).count() == 0


def test_repeated_rows_survive_several_passes(spark):
    rows = [(1, "p q r s t u", "en", "s", 1)] * 3
    items = spark.createDataFrame([(i, f"{w} {x}") for i, (w, x) in enumerate(["pq", "st", "zz", "ab"])], "item_id long, text string")
    got = decontaminate.find(spark.createDataFrame(rows, DOCS), items, block_bytes=3).collect()
    assert [(r.n_hit, r["items"]) for r in got] == [(4, ["0", "1"])] * 3


# ---------------------------------------------------------------- personal data


def brute_spans(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    tests = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    return [[m.span() for m in re.finditer(p, text) if ok(m[0])] for p, ok in tests]


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    texts = ["".join(rng.choice("aZ9.0-@+ ()1-4a.@") for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["4417744280351547", "x 4417-7442-8035-1547.", "a@b.c@d.e f@g", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1", "+1 (017) 555-7713 x"]
    for text in texts:
        assert pii.base_spans(text)[0] == brute_spans(text), repr(text)


def test_registered_counts_and_digest_equal_the_patterns(spark):
    from marquee.llm import queries

    folder, wanted = "/root/testdata/sf0.001", {}
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        spans = brute_spans(row.text or "")
        listed = sorted((start, k, end) for k, found in enumerate(spans) for start, end in found)
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{start}:{end}" for start, k, end in listed).encode()).hexdigest()
        wanted[row.doc_id] = (*map(len, spans), digest)
    rows = queries.op8_pii(spark, folder).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows} == wanted
    assert all(any(w[k] for w in wanted.values()) for k in (0, 1, 3))


def test_long_runs_cost_no_more_than_their_length():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "@" * 100_000, "+1(" * 50_000):
        pii.scan(text)


def test_detection_adds_what_the_base_drops_and_leaves_decoys(spark):
    good, decoy = "4417744280351547", "9807915762804490"
    texts = [f"words about card {good} and more" for _ in range(60)] + [f"some number {decoy} here" for _ in range(60)]
    texts += [f"we had {decoy} {good} in one line", "call +1 (826) 555-4081 190.137.223.204 now", "clean words only", "mail to joe@mail.example.com", None, ""]
    texts += ["call +1 (974) 555-3436 today"] * 30 + ["host 161.17.88.162 is up"] * 30
    df = docs_of(spark, texts)
    got = {i: r.found for i, r in by_id(pii.detect(df).select("doc_id", pii.joined(F.col("spans")).alias("found"))).items()}
    assert got[0] == "card:17:33" and got[60] == ""
    assert got[120] == "card:24:40"
    assert got[121] == "phone:5:22,ip:23:38"
    assert got[122] == got[124] == got[125] == "" and got[123] == "email:8:28"
    redacted = by_id(pii.detect(df, redacted=True))
    assert redacted[121].redacted == "call <PHONE> <IP> now" and redacted[122].redacted == "clean words only" and redacted[124].redacted is None


def test_overlapping_spans_are_redacted_once():
    assert pii.redact("ab 123456 cd", [(2, 3, 9, True, 0), (3, 5, 12, True, 0)]) == "ab <CARD>"


def test_reliabilities_find_the_better_labeler():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = np.full((4000, 5), pii.NONE)
    for j, quality_ in enumerate((0.6, 0.95, 0.8, 0.55, 0.85)):
        right = rng.random(4000) < quality_
        votes[:, j] = np.where(right == truth, pii.YES, pii.NO)
    patterns, weights = np.unique(votes, axis=0, return_counts=True)
    post, table, share = pii.reliabilities(patterns, weights.astype(float))
    assert table[1, 0, pii.YES] > table[2, 0, pii.YES] > table[3, 0, pii.YES]
    of = {tuple(p): q for p, q in zip(patterns, post)}
    assert np.mean([(of[tuple(v)] > 0.5) == t for v, t in zip(votes, truth)]) > 0.93
