"""Conversation repair against a plain search over edit lists, in one range, many ranges and small chunks."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import conversation_repair as repair
from marquee.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, cost int"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Rows of (conv_id, turn, role, text) after damage, by conversation, in order."""
    found = defaultdict(list)
    for conversation, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        kind = zlib.crc32(f"{' ' if conversation is None else conversation}:{' ' if turn is None else turn}".encode()) % 20
        there = found[conversation]
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        there += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for there in found.values():
        there.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    return found


def cheapest(rows, faults):
    """(cost, audit, repaired lines) by trying all edits, best states first by cost, then audit."""
    best = {"": (0, "", ())}  # by the pattern's state: '', s, u, a

    def inserted(states):
        for source, target, name in (("", "u", "user"), ("s", "u", "user"), ("a", "u", "user"), ("u", "a", "assistant"), ("a", "u", "user")):
            if source in states:
                cost, audit, lines = states[source]
                made = (cost + 2, audit + "I", (*lines, f"{name}:"))
                if target not in states or made < states[target]:
                    states[target] = made
        return states

    for (_, role, text), fault in zip(rows, faults):
        states, best = inserted(inserted(dict(best))), {}
        for state, (cost, audit, lines) in states.items():
            options = [(state, (cost + 3, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                need = {"": "u", "s": "u", "a": "u", "u": "a"}[state]
                options.append((need, (cost + 2 + more, audit + "R", (*lines, f"{'user' if need == 'u' else 'assistant'}:{text}"))))
                if role[:1] == need or (role[:1] == "s" and state == ""):
                    options.append((role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
            for target, made in options:
                if target not in best or made < best[target]:
                    best[target] = made
    states = inserted(inserted(dict(best)))
    return min(states[s] for s in ("", "a") if s in states)


def expected(rows):
    out = {}
    for conversation, there in damaged(rows).items():
        seen, faults = set(), []
        for _, role, text in there:
            last = text.rstrip(BLANKS)[-1:]
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in there if t is not None]
        cost, audit, lines = cheapest(there, faults)
        out[conversation] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(there, there[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def made_up(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for c in range(conversations):
        texts = ["One.", "Two!", "cut off", "", " \n", None, "A?", "b.\n"] + [f"t{i}." for i in range(most)]
        for turn in range(rng.randrange(1, most)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "uncle"]) if rng.random() < 0.5 else ("user", "assistant")[turn % 2]
            row = (c if c else None, None if rng.random() < 0.05 else turn + rng.randrange(2), role, rng.choice(texts))
            rows += [row] * rng.choice([1] * 9 + [3])
    return rows


def results(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = df.collect()
    got = {r.conv_id: tuple(r[n] for n in names) for r in found}
    assert len(got) == len(found)
    return got


def test_conversations_of_every_kind(spark):
    rows = made_up(1, 150, 14)
    docs = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA).repartition(3)
    wanted = expected(rows)
    assert results(repair.repair(repair.damage(docs))) == wanted
    assert {"D", "I", "K", "R"} <= set("".join(w[6] for w in wanted.values()))


@pytest.mark.parametrize("most", [1, 2, 7])
def test_small_chunks_give_the_same(spark, most, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", most)
    rows = made_up(most, 25, 20)
    docs = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA)
    assert results(repair.repair(repair.damage(docs))) == expected(rows)


def test_one_conversation_over_many_ranges(spark):
    rows = made_up(3, 3, 8) + [(7, t, ("user", "assistant", "user")[t % 3], f"text {t % 40}" + "." * (t % 5 > 0)) for t in range(600)]
    docs = spark.createDataFrame([(*r, 9) for r in rows], SCHEMA).repartition(4)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert results(repair.repair(repair.damage(docs))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    docs = spark.createDataFrame([(gone, 0, "user", "Hi.", 1)], SCHEMA)
    assert results(repair.repair(repair.damage(docs))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.repair(repair.damage(docs.limit(0))).count() == 0


def test_ranks_order_nodes_by_their_audits():
    rng = random.Random(5)
    codes = [rng.randrange(16) for _ in range(40)]
    node, letter, target = [], [], []
    for place, arcs in repair.Costs().arcs(codes, repair.END):
        for state, choices in enumerate(arcs):
            for kind, passed, to in choices:
                node.append(4 * place + state)
                letter.append(kind)
                target.append(4 * (place + passed) + to)
    n = 4 * (len(codes) + 1)
    letters, rank, pointers, length = repair.least_paths(n, np.array(node), np.array(letter), np.array(target))

    def audit(v):
        out = []
        while letters[v] >= 0:
            out.append(repair.LETTERS[letters[v]])
            v = pointers[0][v]
        return "".join(out)

    audits = [audit(v) for v in range(n)]
    assert [len(a) for a in audits] == length.tolist()
    assert [audits[v] for v in np.argsort(rank, kind="stable")] == sorted(audits)
    assert all((rank[a] == rank[b]) == (audits[a] == audits[b]) for a in range(n) for b in range(n))


def test_registered_query_equals_brute_force_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = expected(rows)
    assert results(queries.op11_conversation_repair(spark, folder)) == wanted
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    found = con.sql(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({queries.ORACLES['op11_conversation_repair']})").fetchall()
    assert {r[0]: r[1:] for r in found} == wanted
