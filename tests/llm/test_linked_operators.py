"""Near duplicates, components, URL filter, tool calls and the pipeline against brute force and odd inputs."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marquee.llm import components, near_dup, queries, tool_calls, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


# ---------------------------------------------------------------- components


def brute_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("links", [
    [(i, i + 1) for i in range(60)],
    [(0, i) for i in range(1, 50)] + [(70 + i, 71 + i) for i in range(9)],
    [((i * 37) % 101, (i * 53) % 101) for i in range(70)],
    [(5, 5)],
])
def test_components_equal_union_find(spark, links):
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute_components([link for link in links if link[0] != link[1]])


@pytest.fixture
def many_partitions(spark):
    """Shuffles of 61 partitions that nothing merges."""
    settings = {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield 61
    for k, v in before.items():
        spark.conf.set(k, v)


def test_rounds_have_as_many_tasks_as_links_need(spark, monkeypatch, many_partitions):
    files, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df, label: (lambda r: files.append(len(r.inputFiles())) or r)(write(df, label)))
    links = [((i * 7919) % 3001, (i * 104729) % 3001) for i in range(2000)]
    wanted = brute_components([link for link in links if link[0] != link[1]])
    cores = spark.sparkContext.defaultParallelism
    for rows, most in ((components.TASK_ROWS, cores), (100, many_partitions)):
        monkeypatch.setattr(components, "TASK_ROWS", rows)
        files.clear()
        assert {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()} == wanted
        assert max(files) <= most and (rows > 100 or max(files) > cores)


# ---------------------------------------------------------------- near duplicates


def brute_near(rows, size, percent=80):
    def shingled(text):
        words = (text or "").encode().lower().split()
        k = min(size, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    sets = [(i, shingled(t)) for i, t in rows]
    links = [
        (a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n]
        if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    found = brute_components([(a, b) for a, b in links if a != b])
    return {i: (len(s), found.get(i, i)) for i, s in sets}


def near_rows(seed=3, n=40):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(30))
    rows, passage = [], " ".join(word() for _ in range(30))
    for _ in range(n):
        base = [word() for _ in range(rng.randrange(1, 60))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = word()
            rows.append("  ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
        rows.append(passage + " " + " ".join(word() for _ in range(rng.randrange(2, 20))))
    rows += [None, "", " \n", "one", "ONE", "one two", "one two", "two one"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(spark, size):
    rows = near_rows()
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs_of(spark, rows), size=size).collect()}
    want = brute_near(rows, size)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_odd_inputs(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (4, text), (4, text), (9, text + " tail"), (2, None), (None, None)]
    df = docs_of(spark, rows).withColumn("id", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert got == [(False, 2, 0, 2, True), (False, 4, 26, 4, True), (False, 4, 26, 4, True), (False, 9, 27, 4, False), (True, 0, 0, None, True), (True, 0, 26, None, True)]
    assert near_dup.near_duplicates(df.where("false")).count() == 0


def test_every_pair_under_the_guaranteed_distance_shares_an_entry():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 2**16, near_dup.VALUES)
        b = a.copy()
        places = rng.choice(near_dup.VALUES, near_dup.GUARANTEED, replace=False)
        b[places] += 1
        equal = (a == b)[None, :]
        number = int(near_dup.first_shared(equal)[0])
        chunk, left = divmod(number, near_dup.WIDTH)
        held = list(near_dup.combinations(range(near_dup.WIDTH), near_dup.WIDTH - near_dup.ERRORS))[left]
        assert all(equal[0, chunk * near_dup.WIDTH + i] for i in held)
        # The entry stays in the index: the first of its chunk, or one whose members differ in the place left out.
        out = near_dup.WIDTH - 1 - left
        assert out not in held and (left == 0 or not equal[0, chunk * near_dup.WIDTH + out])


def join_rows(node):
    """Rows that each join of a plan has made, after it ran."""
    inner = next((getattr(node, name)() for kind, name in (("AdaptiveSparkPlan", "executedPlan"), ("QueryStage", "plan")) if kind in node.nodeName()), None)
    below = [inner] if inner else [node.children().apply(i) for i in range(node.children().size())]
    made = [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
    return made + [n for b in below for n in join_rows(b)]


@pytest.mark.parametrize("block", [256, 3])
def test_signatures_join_members_once_per_id(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    ids, entries = range(8), range(40)
    mixed = spark.createDataFrame([(e, e, i, i // 3) for e in entries for i in ids], "entry long, number int, id long, of long")
    reps = spark.createDataFrame([(i, [i] * near_dup.VALUES) for i in ids], "id long, sig array<smallint>")
    texts = spark.createDataFrame([(i, bytearray(b"t%d" % i)) for i in ids], "id long, data binary")
    for known in (None, texts):
        met = near_dup._meetings(mixed, reps, known)
        pairs = {(r.entry, *sorted((a.id, b.id))) for r in met.collect() for a in r.rows_a for b in r.rows_b if a.of != b.of}
        assert pairs == {(e, a, b) for e in entries for a in ids for b in ids if a < b and a // 3 != b // 3}
        # Members meet their entries' figures one by one, signatures and texts only once per id.
        made = sorted(join_rows(met._jdf.queryExecution().executedPlan()))
        assert [n for n in made if n == len(ids)] and sum(n == len(ids) * len(entries) for n in made) <= (1 if block == 256 else 2)


@pytest.mark.parametrize("block", [256, 3])
def test_blocks_have_as_many_tasks_as_their_work_needs(spark, monkeypatch, many_partitions, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    mixed = spark.createDataFrame([(e, e, i, i // 3) for e in range(40) for i in range(8)], "entry long, number int, id long, of long")
    reps = spark.createDataFrame([(i, [i] * near_dup.VALUES) for i in range(8)], "id long, sig array<smallint>")
    texts = spark.createDataFrame([(i, bytearray(b"t%d" % i)) for i in range(8)], "id long, data binary")
    few = near_dup.TASKS * spark.sparkContext.defaultParallelism
    assert few < many_partitions
    for known in (None, texts):
        assert near_dup._meetings(mixed, reps, known).rdd.getNumPartitions() <= few
    pairs = spark.createDataFrame([(0, i) for i in range(1, 8)], "a long, b long")
    assert near_dup.confirm(pairs, texts, 2, 80, 7).rdd.getNumPartitions() <= few
    # More work, or larger texts, get more tasks.
    monkeypatch.setattr(near_dup, "COMPARED", 1000)
    assert near_dup._meetings(mixed, reps, None).rdd.getNumPartitions() > few
    large = texts.withColumn("data", F.expr("cast(repeat('word ', 400000) as binary)"))
    assert near_dup.confirm(pairs, large, 2, 80, 200).rdd.getNumPartitions() > few


def test_further_links_join_components(spark):
    first, more = [(i, i + 1) for i in range(0, 60, 3)], [(i + 1, i + 3) for i in range(0, 30, 3)] + [(90, 4)]
    groups = components.components(spark.createDataFrame(first, "a long, b long"))
    got = {r.id: r.component for r in near_dup._joined(groups, spark.createDataFrame(more, "a long, b long")).collect()}
    assert got == brute_components(first + more)


def test_sides_of_blocks_are_cut_out_of_batches():
    rng = np.random.default_rng(5)
    rows = [[{"id": int(rng.integers(1 << 40)), "sig": rng.integers(-(1 << 15), 1 << 15, near_dup.VALUES).tolist(), "data": b"x" * k, "of": k} for k in range(n)] for n in (3, 0, 5, 1)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("sig", pa.list_(pa.int16())), ("data", pa.binary()), ("of", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9, 10]), pa.array([1, 2, 3, 4]), pa.array(rows, kind), pa.array(rows[::-1], kind)], names=["entry", "number", "rows_a", "rows_b"])
    for start in (0, 1, 2):
        got = list(near_dup._sides(batch.slice(start)))
        assert [(e, n) for e, n, _, _ in got] == [(7, 1), (8, 2), (9, 3), (10, 4)][start:]
        for want, sides in ((rows, [x[2] for x in got]), (rows[::-1], [x[3] for x in got])):
            assert [[{"id": i, "sig": s, "data": d, "of": o} for i, s, d, o in zip(x.ids.tolist(), x.sigs.tolist(), x.data.to_pylist(), x.of.tolist())] for x in sides] == want[start:]


# ---------------------------------------------------------------- URL filter


def brute_rule(host, path):
    best = None
    for verdict, rule_host, rule_path in url_filter.RULES:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            if best is None or len(rule_host + rule_path) > len(best[0]):
                best = (rule_host + rule_path, verdict)
    return best or (None, None)


URLS = [
    None, "", "no scheme.com/en/", "http://", "http://COM", "https://Example.COM/en/1?x=1#y", "http://www.example.com/en/2", "http://a.www.example.com/en/2",
    "ftp://notexample.com/en/", "http://x.example.com/fr/", "http://example.net/es/1", "http://example.net/en/1", "http://net/fr/", "http://b.org?x=://c.com/",
    "http://h.com#f", "http://h.com/p?q#f?g", "://com/", "x://y://com/en/", "http://example.com:80/en/", "HTTP://É.com/en/", "http://" + "a" * 5000 + ".org/" + "9" * 5000,
]


def brute_parse(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    return host, rest[n:].split("?")[0].split("#")[0]


def test_rules_equal_brute_force(spark):
    urls = URLS + [f"http://h{i}.example.{t}/{p}/{i}" for i in range(40) for t in ("com", "net", "org") for p in ("en", "es")]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    for i, url in enumerate(urls):
        host, path = brute_parse(url)
        rule, verdict = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")


def test_trees_learn_from_labelled_urls(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        bad = rng.random() < 0.5
        name = f"{rng.randrange(10**9)}-x-{rng.randrange(10**6)}" if bad else rng.choice(["news", "garden", "library"]) + rng.choice("abc")
        top = rng.choice(["good", "bad"]) if i % 3 == 0 else ("labelled-bad" if bad else "labelled-good")
        rows.append((i, f"http://{name}.{top}/{'a/' * (4 if bad else 1)}p", bad))
    rules = (("block", "labelled-bad", "/"), ("allow", "labelled-good", "/"))
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = url_filter.judge(df, rules).join(df, "page_id").where("rule is null").selectExpr("avg(int((verdict = 'block') = bad)) AS a").first().a
    assert got > 0.95


def test_filter_without_labelled_urls(spark):
    df = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(df).collect()] == ["allow"] * 3
    assert url_filter.judge(df.where("false")).count() == 0


# ---------------------------------------------------------------- tool calls

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULTS = "conv_id long, turn long, call_id string, content string"
ADD = {"add": (("x", "BIGINT", True), ("note", "STRING", False))}


def link(spark, calls, results, schemas=ADD):
    df = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), schemas)
    return sorted(df.collect(), key=lambda r: (r.conv_id, r.call_id or "", r.status, r.turn or 0))


def test_status_of_calls_and_results(spark):
    calls = [
        (1, 0, "a", "add", '{"x": 1}', None), (1, 1, "a", "add", '{"x": 2}', None), (1, 2, "b", "add", '{"x": 3}', None), (1, 9, "c", "add", '{"x": 3}', []),
        (1, 3, None, "add", "{}", None), (1, 0, "a", "add", '{"x": 1}', None),
    ]
    results = [(1, 1, "a", "one"), (1, 2, "a", "late"), (1, 4, "c", "early"), (2, 1, "z", None), (1, 5, None, "lost")]
    got = [(r.conv_id, r.call_id, r.status, r.turn, r.result_turn) for r in link(spark, calls, results)]
    assert got == [
        (1, None, "orphan", None, 5), (1, None, "unanswered", 3, None), (1, "a", "duplicate", 1, None), (1, "a", "linked", 0, 1),
        (1, "b", "unanswered", 2, None), (1, "c", "early", 9, 4), (2, "z", "orphan", None, 1),
    ]


def test_arguments_against_schemas(spark):
    cases = {
        '{"x": 1}': [], '{"x": 1, "note": "n"}': [], '{"x": "1"}': ["x: not BIGINT"], "{}": ["x: missing"], "[1]": ["arguments: not an object"],
        "{broken": ["arguments: not an object"], None: ["arguments: not an object"], '{"x": 1, "y": 2}': ["arguments: unknown field"],
        '{"x": 1, "note": ""}': ["note: empty"], '{"x": null}': ["x: not BIGINT"],
    }
    calls = [(1, i, f"c{i:02d}", "add", text, None) for i, text in enumerate(cases)] + [(1, 50, "d", "other", "{}", None)]
    got = link(spark, calls, [])
    assert [list(r.problems) for r in got] == [*cases.values(), ["name: unknown tool"]]


def test_canonical_json(spark):
    calls = [(1, 0, "a", "add", ' { "note" : "q\\"\\u00e9\\n", "x" : 1 } ', None), (1, 1, "b", "add", "nonsense", None)]
    first, second = link(spark, calls, [(1, 1, "a", "re\nsult")])
    assert first.record == '{"arguments":{"note":"q\\"é\\n","x":1},"id":"a","name":"add","result":"re\\nsult"}'
    assert json.loads(second.record) == {"arguments": {"text": "nonsense"}, "id": "b", "name": "add", "result": None}


def test_order_follows_needs(spark):
    body = '{"x": 1}'
    calls = [
        (1, 0, "a", "add", body, []), (1, 1, "b", "add", body, ["a"]), (1, 2, "c", "add", body, ["b", "missing"]),
        (2, 0, "a", "add", body, ["c"]), (2, 1, "b", "add", body, ["a"]), (2, 2, "c", "add", body, []),
        (3, 0, "a", "add", body, ["b"]), (3, 1, "b", "add", body, ["a"]), (3, 2, "c", "add", body, ["b"]), (3, 3, "d", "add", body, []), (4, 0, "s", "add", body, ["s"]),
    ]
    got = {(r.conv_id, r.call_id): r.level for r in link(spark, calls, [])}
    assert [got[1, c] for c in "abc"] == [0, 0, 0]
    assert [got[2, c] for c in "abc"] == [1, 2, 0]
    assert [got[3, c] for c in "abcd"] == [None, None, None, 0] and got[4, "s"] is None


def test_calls_without_turns_follow_their_needs(spark):
    """A null turn orders nothing, so such a conversation gets levels, and its cycles are found."""
    body, cycle = '{"x": 1}', ["after: on or behind a cycle"]
    calls = [
        (1, None, "a", "add", body, []), (1, None, "b", "add", body, ["a"]), (1, None, "c", "add", body, ["b"]),
        (2, None, "a", "add", body, ["b"]), (2, None, "b", "add", body, ["a"]), (3, 4, "a", "add", body, []), (3, None, "b", "add", body, ["a"]),
    ]
    got = {(r.conv_id, r.call_id): (r.level, r.problems) for r in link(spark, calls, [])}
    assert [got[1, c] for c in "abc"] == [(0, []), (1, []), (2, [])]
    assert [got[2, c] for c in "ab"] == [(None, cycle)] * 2 and [got[3, c] for c in "ab"] == [(0, []), (1, [])]


def test_needs_that_cannot_be_met_are_problems(spark):
    body = '{"x": 1}'
    calls = [
        (1, 0, "a", "add", body, []), (1, 1, "b", "add", body, ["a"]), (1, 2, "c", "add", body, ["b", "missing", None, "missing"]), (1, 3, None, "add", "{}", ["a", "z"]),
        (2, 0, "a", "add", body, ["c"]), (2, 1, "c", "add", body, []), (3, 0, "a", "add", body, ["b"]), (3, 1, "b", "add", body, ["a"]), (3, 2, "c", "add", body, ["b", "gone"]),
        (3, 3, "d", "add", body, None),
    ]
    got = {(r.conv_id, r.call_id): list(r.problems) for r in link(spark, calls, [(3, 9, "orphan", "x")])}
    cycle = "after: on or behind a cycle"
    assert got == {
        (1, "a"): [], (1, "b"): [], (1, "c"): ["after: no call missing", "after: no call null"], (1, None): ["after: no call z", "x: missing"], (2, "a"): [], (2, "c"): [],
        (3, "a"): [cycle], (3, "b"): [cycle], (3, "c"): ["after: no call gone", cycle], (3, "d"): [], (3, "orphan"): [],
    }


def test_every_distinct_call_and_result_comes_back(spark):
    body = '{"x": 1}'
    calls = [(1, 0, "a", "add", body, None), (1, 1, "a", "add", body, None)] + [(None, t, "0", "add", body, None) for t in range(3)] + [(3, None, "n", None, None, None)]
    results = [(1, 1, "a", "one"), (1, 2, "a", "late"), (1, 2, "a", "late"), (2, 1, "z", "p"), (2, 1, "z", "q")] + [(None, 1, "0", t) for t in ("u", "v")]
    df = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), ADD, repeats=True)
    got = sorted((r.conv_id or 0, r.status, r.turn is None, r.turn or 0, json.loads(r.record)["result"] or "", r.level is None, len(r.problems)) for r in df.collect())
    assert got == [
        (0, "orphan", True, 0, "u", True, 0), (0, "orphan", True, 0, "v", True, 0),
        (0, "unanswered", False, 0, "", False, 0), (0, "unanswered", False, 1, "", False, 0), (0, "unanswered", False, 2, "", False, 0),
        (1, "duplicate", False, 1, "", False, 0), (1, "duplicate", True, 0, "late", True, 0), (1, "linked", False, 0, "one", False, 0),
        (2, "duplicate", True, 0, "q", True, 0), (2, "orphan", True, 0, "p", True, 0), (3, "unanswered", True, 0, "", False, 2),
    ]


def test_query_keeps_two_answers_of_a_turn(spark, tmp_path):
    rows = [(1, 0, "user", "x"), (1, 1, "assistant", "a"), (1, 1, "assistant", "b")] + [(None, 0, "user", t) for t in "pqr"]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op1_tool_calls(spark, str(tmp_path)).collect()
    assert sorted(r.status for r in got) == ["duplicate", "linked", "unanswered", "unanswered", "unanswered"]


def test_chat_as_calls(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi"), (1, 3, "user", None), (1, 5, "assistant", "alone"), (None, 0, "user", "x"), (1, 1, "user", "hello")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("name", F.lit("clash"))
    got = tool_calls.link(*tool_calls.exchanges(messages)).collect()
    assert sorted((r.conv_id or 0, r.call_id, r.status, tuple(r.problems)) for r in got) == [
        (0, "0", "unanswered", ()), (1, "1:1", "linked", ()), (1, "1:3", "unanswered", ("text: missing",)), (1, "1:4", "orphan", ()),
    ]
    assert tool_calls.link(*tool_calls.exchanges(messages.where("false"))).count() == 0


def test_rows_of_other_roles_come_back(spark):
    rows = [(1, 0, "system", "s"), (1, 0, "tool", None), (1, 0, None, "n"), (2, 0, "system", "s"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tool_calls.link(*tool_calls.exchanges(messages, others=True), repeats=True).collect()
    other = [(r.conv_id, r.status, *json.loads(json.loads(r.record)["result"]).values()) for r in got if r.call_id is None]
    assert sorted(other, key=repr) == [(1, "orphan", "system", "s"), (1, "orphan", "tool", None), (1, "orphan", None, "n"), (2, "orphan", "system", "s")]
    assert [(r.call_id, r.status) for r in got if r.call_id] == [("1:1", "linked")]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_near_duplicates_broadcast_no_exploded_index(spark, monkeypatch, threshold):
    """Spark guesses the index of entries far too small, so nothing made of it may be broadcast whatever the threshold."""
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(20)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [t + " end" for t in texts[:10]])], "doc_id long, text string")
    plans, write = {}, near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df, label: plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString()) and write(df, label))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, size=2).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {i: i % 20 for i in range(30)}
    for label in ("near-members", "near-pairs", "near-links"):
        assert "SortMergeJoin" in plans[label] and "BroadcastHashJoin" not in plans[label], label
