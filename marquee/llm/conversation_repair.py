"""Conversation structure repair: the cheapest edits that make a conversation alternate, the least of them by their audit.

A repaired conversation has role initials ``(s?(ua)+)?``. Read from the front, its state is one of four: nothing yet, after
the system row, after a user row, after an assistant row. Rows are kept, given the role that the state needs, or deleted, and
empty rows are inserted. The cost DP runs from the back and gives each node (place, state) its cost to the end; arcs that
keep to it are optimal. Nodes are then ranked by the least audits of 1, 2, 4, ... letters that optimal arcs spell: a rank of
twice the length is a pair of ranks, the second at the node a doubled pointer leads to. Ranks select one arc per node, and
the pointers give all nodes of the path at once.

Equal rows are counted, not carried, and all others have different sort keys, so ranges of (conversation, turn, role, digest)
are of even size even if one conversation holds most rows. A conversation inside one range is finished in that task. The
others are cut into chunks of bounded rows and bytes; a chunk's DP is a min-plus matrix of four by four states, so the costs
after each chunk come from a scan of matrices, and the states it is entered in from a scan of state maps: first inside each
range, then over the ranges of a conversation, then back, so no task holds more than a range of chunks or one entry per
range. Only the digest of the repaired text, one value by definition, is taken in one stream per conversation.

Defined cases: a null role or text is one space; null turns come first; rows of one turn are ordered by role, then by the
SHA-256 of the text; equal rows stand together and all but the first are duplicates; a role's initial is its first character;
a null conversation is one conversation; very long texts are chunks of their own; one whose rows are all dropped has zeros, no
audit and the digest of nothing; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from marquee.llm.common import written

BLANKS = " \t\n\x0b\x0c\r"
CHUNK_ROWS = 4096
CHUNK_BYTES = 1 << 18
BATCH_ROWS = 20_000
BATCH_BYTES = 4 << 20

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)  # the role that each state needs
LETTERS = "DIKR"  # in ASCII order
DELETE, INSERT, KEEP, REROLE = range(4)
COST = np.array([3, 2, 0, 2])
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": 0, "u": 1, "a": 2}
KEPT = {(0, NOTHING): SYSTEM, (1, NOTHING): USER, (1, SYSTEM): USER, (1, ASSISTANT): USER, (2, USER): ASSISTANT}
LEGAL = {"su", "ua", "au"}
END = (0, 4, 2, 0)  # inserts needed at the end of a conversation
FAR = 1 << 40

# ---------------------------------------------------------------- damage


def damage(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and n, the times a row stands there after damage; dropped rows have n = 0 and no text."""
    text = lambda column: F.coalesce(F.col(column).cast("string"), F.lit(" "))
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return rows.withColumn("_kind", kind).select(
        "conv_id", "turn",
        F.when(F.col("_kind") == 0, "").when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Different rows with n, their times, blank, first (no row of an earlier turn has its role and text) and cut (truncated).
    Rows that are deleted anyway carry no text."""
    counted = rows.withColumn("digest", F.sha2("text", 256)).groupBy("conv_id", "turn", "role", "digest").agg(F.sum("n").alias("n"), F.first("text").alias("text"))
    key = F.struct("conv_id", "role", "digest")  # a struct of nulls equals itself in joins
    there = counted.where("n > 0").withColumn("_key", key)
    earliest = there.groupBy("_key").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("_least"))
    seen = counted.withColumn("_key", key).join(earliest, "_key", "left")
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    blank, first = last == "", F.struct(F.col("turn").isNotNull(), "turn").eqNullSafe(F.col("_least"))
    return seen.select(
        "conv_id", "turn", "role", "digest", "n", blank.alias("blank"), first.alias("first"), (~last.isin(*".!?")).alias("cut"),
        F.when(first & ~blank & (F.col("n") > 0), F.col("text")).alias("text"),
    )


# ---------------------------------------------------------------- costs and paths


def row_code(initial: int, must_go: bool, cut: bool) -> int:
    return initial << 2 | must_go << 1 | cut


def step(after: Sequence[int], code: int) -> tuple[list[int], list[list[tuple[int, int, int]]]]:
    """The costs to the end before a row, and per state the optimal arcs (letter, rows passed, state)."""
    initial, must_go, cut = code >> 2, code >> 1 & 1, code & 1
    options = []
    for state in range(4):
        arcs = [(3 + after[state], DELETE, 1, state)]
        if not must_go:
            arcs.append((2 + cut + after[NEXT[state]], REROLE, 1, NEXT[state]))
            kept = KEPT.get((initial, state))
            if kept is not None:
                arcs.append((cut + after[kept], KEEP, 1, kept))
        options.append(arcs)
    onward = [min(arcs)[0] for arcs in options]
    # One or two inserts may come first; a third would lead back to a state already seen.
    costs = [min(onward[s], 2 + onward[NEXT[s]], 4 + onward[NEXT[NEXT[s]]]) for s in range(4)]
    for state in range(4):
        options[state].append((2 + costs[NEXT[state]], INSERT, 0, NEXT[state]))
    return costs, [[(letter, passed, to) for cost, letter, passed, to in options[s] if cost == costs[s]] for s in range(4)]


class Costs:
    """Remembers steps: costs only differ by small numbers, so few different ones occur."""

    def __init__(self):
        self.steps: dict = {}

    def arcs(self, codes: Sequence[int], after: Sequence[int]) -> Iterator[tuple[int, list]]:
        """(place, arcs per state) of a chunk, from its last row to its first."""
        least = min(after)
        after = tuple(c - least for c in after)
        for place in range(len(codes) - 1, -1, -1):
            key = after, codes[place]
            found = self.steps.get(key)
            if found is None:
                costs, arcs = step(after, codes[place])
                found = self.steps[key] = tuple(c - min(costs) for c in costs), arcs
            after, arcs = found
            yield place, arcs


def matrix(codes: Sequence[int]) -> list[int]:
    """Cost from each state before a chunk to each state after it, row by row."""
    columns = []
    for target in range(4):
        after = [0 if s == target else FAR for s in range(4)]
        for code in reversed(codes):
            after, _ = step(after, code)
        columns.append(after)
    return [min(columns[t][s], FAR) for s in range(4) for t in range(4)]


def least_paths(n_nodes: int, node: np.ndarray, letter: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Per node the letter of its selected arc, its rank, the pointers over 1, 2, 4, ... arcs, and the length of its path.

    Nodes without arcs point to themselves. A letter fixes where an arc leads, so the least letter has one arc.
    """
    order = np.lexsort((letter, node))
    node, letter, target = node[order], letter[order], target[order]
    first = np.flatnonzero(np.diff(node, prepend=-1))
    rank, pointer = np.zeros(n_nodes, np.int64), np.arange(n_nodes)
    rank[node[first]], pointer[node[first]] = letter[first] + 1, target[first]
    length = (rank > 0).astype(np.int64)
    pointers = [pointer]
    while (pointer[pointer] != pointer).any():
        pair = rank * (rank.max(initial=0) + 1) + rank[pointer]
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        length, pointer = length + length[pointer], pointer[pointer]
        pointers.append(pointer)
    chosen = np.lexsort((rank[target], letter, node))
    chosen = chosen[np.flatnonzero(np.diff(node[chosen], prepend=-1))]
    letters = np.full(n_nodes, -1)
    letters[node[chosen]] = letter[chosen]
    pointers[0][node[chosen]] = target[chosen]
    return letters, rank, pointers, length


def paths(chunks: Sequence[tuple[Sequence[int], Sequence[int], Sequence[int]]], costs: Costs) -> list[list[tuple[list[int], list[int], list[int]]]]:
    """For (row codes, costs after, entry states) of each chunk and each of its entry states: letters, places and the states
    after each letter. A last state without a letter is not listed."""
    node, letter, target, starts, base = [], [], [], [], 0
    for codes, after, entries in chunks:
        for place, arcs in costs.arcs(codes, after):
            for state, choices in enumerate(arcs):
                for kind, passed, to in choices:
                    node.append(base + 4 * place + state)
                    letter.append(kind)
                    target.append(base + 4 * (place + passed) + to)
        starts += [base + state for state in entries]
        base += 4 * (len(codes) + 1)
    letters, _, pointers, length = least_paths(base, np.array(node, np.int64), np.array(letter, np.int64), np.array(target, np.int64))
    lengths = length[np.array(starts, np.int64)] if starts else np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    at, number = np.repeat(np.array(starts, np.int64), lengths), np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    for k, pointer in enumerate(pointers):
        moved = (number >> k & 1).astype(bool)
        at[moved] = pointer[at[moved]]
    spelled, after = letters[at].tolist(), pointers[0][at] if len(at) else at
    out, base, place = [], 0, 0
    for codes, _, entries in chunks:
        found = []
        for _ in entries:
            end = ends[place]
            part = slice(end - lengths[place], end)
            found.append((spelled[part], ((at[part] - base) >> 2).tolist(), ((after[part] - base) & 3).tolist()))
            place += 1
        out.append(found)
        base += 4 * (len(codes) + 1)
    return out


# ---------------------------------------------------------------- chunks


class Chunk:
    """Part of a conversation after damage: a code per row, the rows that may stay, and what is counted."""

    def __init__(self, conversation):
        self.conversation, self.codes, self.rows, self.bytes = conversation, [], {}, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first = self.last = ""
        self.first_turn = self.last_turn = None

    def full(self) -> bool:
        return len(self.codes) >= CHUNK_ROWS or self.bytes >= CHUNK_BYTES

    def add(self, turn, role: str, kind: str, n: int, text: str | None) -> int:
        """Up to ``n`` rows of one kind, as many as fit; their number."""
        n = min(n, CHUNK_ROWS - len(self.codes))
        initial = role[:1]
        self.illegal += (n - 1) * (initial * 2 not in LEGAL) + (bool(self.codes) and self.last + initial not in LEGAL)
        if not self.codes:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        setattr(self, kind, getattr(self, kind, 0) + n)
        if text is not None:
            self.rows[len(self.codes)] = role, text
            self.bytes += len(text)
        code = row_code(INITIALS.get(initial, 3), kind in ("blank", "duplicate"), kind == "truncated")
        self.codes += [code] * n
        return n


def chunks_of(batches) -> Iterator[tuple[Chunk, bool, bool]]:
    """Chunks of sorted rows, with whether each begins and ends its conversation as far as the rows show."""
    chunk, begins, held = None, True, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "n", "blank", "first", "cut", "text")]
        for conversation, turn, role, n, blank, first, cut, text in zip(*columns):
            if chunk is None or chunk.conversation != conversation or (chunk.conversation is None) != (conversation is None):
                if chunk is not None:
                    yield chunk, begins, True
                chunk, begins = Chunk(conversation), True
            runs = [("blank", n, None)] if blank else [("duplicate", n, None)]
            if n and not blank and first:
                runs = [("truncated" if cut else "fine", 1, text), ("duplicate", n - 1, None)]
            for kind, left, content in runs:
                while left:
                    if chunk.full():
                        yield chunk, begins, False
                        chunk, begins = Chunk(conversation), False
                    left -= chunk.add(turn, role, kind, left, content)
    if chunk is not None:
        yield chunk, begins, True


def spell(chunk_rows: dict[int, tuple[str, str]], codes: Sequence[int], path: tuple[list[int], list[int], list[int]]) -> tuple[str, list[str], int]:
    """Audit, repaired lines and cost of a path."""
    lines, cost = [], 0
    for letter, place, state in zip(*path):
        cost += int(COST[letter])
        if letter == INSERT:
            lines.append(f"{NAMES[state]}:")
        elif letter != DELETE:
            role, text = chunk_rows[place]
            lines.append(f"{role if letter == KEEP else NAMES[state]}:{text}")
            cost += codes[place] & 1
    return "".join([LETTERS[x] for x in path[0]]), lines, cost


def closing(state: int) -> list[str]:
    """Lines inserted at the end of a conversation."""
    lines = []
    while END[state]:
        state = NEXT[state]
        lines.append(f"{NAMES[state]}:")
    return lines


MEASURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
PARTS = (
    "codes array<int>, places array<int>, roles array<string>, texts array<string>, matrix array<long>, first string, last string, "
    "first_turn long, last_turn long, n_turns long"
)


def _gaps(first, last, n: int) -> int:
    return 0 if first is None else last - first + 1 - n


def _whole(chunk: Chunk, path) -> tuple:
    audit, lines, cost = spell(chunk.rows, chunk.codes, path)
    more = closing(path[2][-1] if path[2] else NOTHING)
    digest = hashlib.sha256("\n".join(lines + more).encode()).hexdigest()
    return (
        _gaps(chunk.first_turn, chunk.last_turn, chunk.n_turns), chunk.blank, chunk.duplicate, chunk.truncated, chunk.illegal,
        cost + 2 * len(more), audit + "I" * len(more), digest,
    )


def ranges(rows: DataFrame) -> DataFrame:
    """Sorted ranges of rows: a finished row per conversation inside a range, a row per chunk of the others."""
    order = ["conv_id", "turn", "role", "digest"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    key = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    schema = rows.sparkSession.createDataFrame([], f"{key}, whole boolean, part long, chunk long, {MEASURES}, {PARTS}").schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        part, costs, first = TaskContext.get().partitionId(), Costs(), True
        done, number, out, held, size = [], 0, [], 0, 0
        waiting = None  # the last conversation may go on in the next range

        def flush():
            found = paths([(c.codes, END, (NOTHING,)) for c in done], costs)
            for chunk, (path,) in zip(done, found):
                out.append((chunk.conversation, True, None, None, *_whole(chunk, path), *[None] * 10))
            table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in out], schema=arrow)
            done.clear()
            out.clear()
            return table.to_batches()

        def unfinished(chunk):
            nonlocal number
            number += 1
            places = list(chunk.rows)
            return (
                chunk.conversation, False, part, number, None, chunk.blank, chunk.duplicate, chunk.truncated, chunk.illegal, None, None, None,
                chunk.codes, places, [chunk.rows[p][0] for p in places], [chunk.rows[p][1] for p in places], matrix(chunk.codes),
                chunk.first, chunk.last, chunk.first_turn, chunk.last_turn, chunk.n_turns,
            )

        opened = True  # the conversation being read may have begun in the range before
        for chunk, begins, ends in chunks_of(batches):
            if waiting is not None:
                done.append(waiting)
                waiting = None
            opened = opened and (first or not begins)
            first = False
            if begins and ends and not opened:
                waiting = chunk
            else:
                out.append(unfinished(chunk))
            held, size = held + len(chunk.codes) + 1, size + chunk.bytes
            if held > BATCH_ROWS or size > BATCH_BYTES:
                yield from flush()
                held = size = 0
        if waiting is not None:
            out.append(unfinished(waiting))
        yield from flush()

    return ordered.mapInArrow(run, schema)


# ---------------------------------------------------------------- scans over chunks


def _scan(chunks: DataFrame, value: str, kind: str, join: Callable, use: Callable, start, backward: bool, state: str) -> DataFrame:
    """What holds at each chunk of a conversation, as column ``at``: ``start`` at one end, carried over the chunks between by
    ``use``. Values are joined inside each range, carried over the ranges, and then over the chunks of each range."""
    sign = -1 if backward else 1

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values("chunk")[value].tolist()
        total = values[0]
        for v in values[1:]:
            total = join(total, v)
        return pd.DataFrame({"_key": pdf["_key"].iloc[:1].tolist(), "part": pdf["part"].iloc[:1].tolist(), value: [list(total)]})

    def carry(pdf: pd.DataFrame, by: str, begin) -> pd.DataFrame:
        pdf, at, out = pdf.sort_values(by, ascending=sign > 0), begin, []
        for v in pdf[value]:
            out.append(at)
            at = use(v, at)
        return pdf.assign(at=out)

    first = lambda pdf: carry(pdf, "part", start)[["_key", "part", "at"]]
    second = lambda pdf: carry(pdf, "chunk", pdf["begin"].iloc[0])[["_key", "part", "chunk", "at"]]
    parts = chunks.groupBy("_key", "part").applyInPandas(joined, f"_key string, part long, {value} {kind}")
    begun = parts.groupBy("_key").applyInPandas(first, f"_key string, part long, at {state}")
    inside = chunks.join(begun.withColumnRenamed("at", "begin"), ["_key", "part"])
    return inside.groupBy("_key", "part").applyInPandas(second, f"_key string, part long, chunk long, at {state}")


def _product(a, b) -> list[int]:
    a, b = np.array(a, np.int64).reshape(4, 4), np.array(b, np.int64).reshape(4, 4)
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR).ravel().tolist()


def _before(chunk, after) -> list[int]:
    return (np.array(chunk, np.int64).reshape(4, 4) + np.array(after, np.int64)).min(axis=1).tolist()


def costs_after(chunks: DataFrame) -> DataFrame:
    """Costs to the end after each chunk."""
    return _scan(chunks.select("_key", "part", "chunk", "matrix"), "matrix", "array<long>", _product, _before, list(END), True, "array<long>")


def states_before(chunks: DataFrame) -> DataFrame:
    """The state in which the least path enters each chunk; ``exits`` gives the state it leaves in for each one."""
    follow = lambda a, b: [int(b[x]) for x in a]
    return _scan(chunks.select("_key", "part", "chunk", "exits"), "exits", "array<int>", follow, lambda v, s: int(v[s]), NOTHING, False, "int")


def _exits(chunks: DataFrame) -> DataFrame:
    """Where the least path from each state leads."""

    def run(batches):
        costs = Costs()
        for batch in batches:
            rows = batch.to_pylist()
            found = paths([(r["codes"], r["at"], range(4)) for r in rows], costs)
            exits = [[path[2][-1] if path[2] else s for s, path in enumerate(each)] for each in found]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_key", "part", "chunk")], pa.array(exits, pa.list_(pa.int32()))], ["_key", "part", "chunk", "exits"])

    return chunks.mapInArrow(run, "_key string, part long, chunk long, exits array<int>")


def _finish(chunks: DataFrame) -> DataFrame:
    """Join the chunks of each conversation in order, one after the other."""
    ordered = chunks.repartition("_key").sortWithinPartitions("_key", "part", "chunk")
    schema = chunks.sparkSession.createDataFrame([], f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, {MEASURES}").schema
    arrow = to_arrow_schema(schema)

    class Joined:
        def __init__(self, row):
            self.key, self.conversation, self.counts = row["_key"], row["conv_id"], [0] * 4
            self.last, self.turns, self.n_turns = None, [None, None], 0
            self.cost, self.audit, self.digest, self.lines, self.state = 0, [], hashlib.sha256(), 0, NOTHING

        def write(self, lines):
            if lines:
                self.digest.update(("\n" * (self.lines > 0) + "\n".join(lines)).encode())
                self.lines += len(lines)

        def add(self, row, path):
            audit, lines, cost = spell(dict(zip(row["places"], zip(row["roles"], row["texts"]))), row["codes"], path)
            self.write(lines)
            self.audit.append(audit)
            self.cost += cost
            self.counts = [a + row[c] for a, c in zip(self.counts, COUNTS)]
            if row["codes"]:
                self.counts[3] += self.last is not None and self.last + row["first"] not in LEGAL
                self.last = row["last"]
            if row["n_turns"]:
                self.n_turns += row["n_turns"] - (self.turns[1] == row["first_turn"])
                self.turns = [row["first_turn"] if self.turns[0] is None else self.turns[0], row["last_turn"]]
            self.state = path[2][-1] if path[2] else self.state

        def row(self):
            more = closing(self.state)
            self.write(more)
            return (
                self.conversation, _gaps(*self.turns, self.n_turns), *self.counts, self.cost + 2 * len(more), "".join(self.audit) + "I" * len(more),
                self.digest.hexdigest(),
            )

    def run(batches):
        costs, joined = Costs(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if joined is None or joined.key != row["_key"]:
                    if joined is not None:
                        out.append(joined.row())
                    joined = Joined(row)
                (path,), = paths([(row["codes"], row["at"], (row["entry"],))], costs)
                joined.add(row, path)
            yield from pa.Table.from_pylist([dict(zip(schema.names, r)) for r in out], schema=arrow).to_batches()
        if joined is not None:
            yield from pa.Table.from_pylist([dict(zip(schema.names, joined.row()))], schema=arrow).to_batches()

    return ordered.mapInArrow(run, schema)


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation. ``rows`` are
    like those of ``damage``: conv_id, turn, role, text and n."""
    found = written(ranges(with_faults(rows)), "conversations")
    names = ["conv_id", *[field.split()[0] for field in MEASURES.split(", ")]]
    whole = found.where("whole").select(names)
    # Conversations by a text that tells a null from all others.
    chunks = found.where("not whole").withColumn("_key", F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))))
    at = written(costs_after(chunks), "conversation-costs")
    place = ["_key", "part", "chunk"]
    exits = _exits(chunks.select(*place, "codes").join(at, place))
    entries = states_before(written(exits, "conversation-exits")).withColumnRenamed("at", "entry")
    return whole.unionAll(_finish(chunks.join(at, place).join(entries, place)).select(names))
