"""Secret scans with a trigram inverted index.

A Boolean query over trigrams is derived from each rule's regular expression: what any match must contain. A slice of texts
of bounded bytes is one segment of the index: for every trigram that some query names it holds the sorted rows that have
it. Queries intersect and unite these postings, and only the rows they leave are searched with the expression. A rule
whose expression has no mandatory trigram searches every row of the segment. Segments depend on nothing else, so there
is no shuffle, and a lost task is simply run again.

Trigrams are of UTF-8 bytes with A-Z lower-cased, so rules in either case share an index. The query is only a filter: a row
it lets through may hold nothing, a row it stops can't match.

Defined cases: null and empty texts have no spans; a very long text is a segment of its own, indexed in parts that overlap
by two bytes; spans of one kind never overlap, those of different kinds may, but an added span (a rule that isn't base)
is left out where it overlaps a base span; of equal starts the rule listed first comes first; repeated rows and ids each
keep their row; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import map_texts, worker_cache

SEGMENT_BYTES = 1 << 20
PART_BYTES = 4 << 20
# Strings an expression part may stand for before its set is cut to the last two characters, and characters of a class.
MOST_STRINGS = 256
MOST_MEMBERS = 16
# More alternatives than this are searched for by what they share.
MOST_RESTS = 16
SPANS = "spans array<struct<kind:string,start:int,end:int,base:boolean>>"


@dataclass(frozen=True)
class Rule:
    """``least`` characters are needed in the match, or in its group ``group``."""

    kind: str
    pattern: str
    base: bool = False
    group: int = 0
    least: int = 1


RULES = (
    # Fixed values of the contract.
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", True, 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", True, 0, 32),
    # Published formats of credentials.
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("payment_key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("map_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("bearer", r"(?ai:bearer)\x20+[A-Za-z0-9._~+/-]{16,}=*"),
    Rule("login_url", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*://[^\s:@/]+:[^\s:@/]+@[^\s@/]+"),
)

# ---------------------------------------------------------------- queries

# A query is a trigram, ("and", queries) or ("or", queries). An empty conjunction holds for every row.
ALL = ("and", frozenset())


def every(queries: Iterable) -> tuple | str:
    found = frozenset(q for q in queries if q != ALL)
    return next(iter(found)) if len(found) == 1 else ("and", found)


def either(queries: Iterable) -> tuple | str:
    """What all alternatives need, and one of their rests if those are few."""
    found = [q[1] if q[0] == "and" else frozenset([q]) for q in frozenset(queries)]
    shared = frozenset.intersection(*found) if found else frozenset()
    rests = {q - shared for q in found}
    if len(rests) < 2 or frozenset() in rests or (shared and len(rests) > MOST_RESTS):
        return every(shared)
    return every([*shared, ("or", frozenset(every(rest) for rest in rests))])


def _contains(strings: Iterable[str]) -> tuple | str:
    """One of the strings occurs; nothing is known if one of them has no trigram."""
    return either(every(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _bytes(code: int, flags: int) -> str | None:
    """A character as Latin-1 letters for its bytes; none where its case or a zero byte leaves it open."""
    if code >= 128:
        return None if flags & re.I else chr(code).encode().decode("latin-1")
    letter = chr(code).lower()
    if flags & re.I and not flags & re.A and letter in "iks":
        return None  # other letters than ASCII ones equal these in either case
    return letter if code else None


def _members(items: list, flags: int) -> set[str] | None:
    """The characters of a class, none if they are too many or not listed."""
    found: set[str] = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            codes = (value,)
        elif name == "RANGE" and value[1] - value[0] < MOST_MEMBERS:
            codes = range(value[0], value[1] + 1)
        else:
            return None
        made = [_bytes(c, flags) for c in codes]
        if None in made:
            return None
        found.update(made)
    return found if len(found) <= MOST_MEMBERS else None


class _Run:
    """Strings that the parts read so far can end in, and what was found mandatory before."""

    def __init__(self):
        self.strings, self.whole, self.found = {""}, True, []

    def cut(self, keep: bool) -> None:
        """Note what the strings need, then go on from their last two characters, or from nothing known."""
        self.found.append(_contains(self.strings))
        self.strings = {s[-2:] for s in self.strings} if keep else {""}
        self.whole = False

    def extend(self, strings: set[str]) -> None:
        if len(self.strings) * len(strings) > MOST_STRINGS:
            self.cut(True)
        if len(self.strings) * len(strings) > MOST_STRINGS:
            self.cut(False)
        if len(strings) > MOST_STRINGS:
            self.found.append(_contains(strings))
            return
        self.strings = {a + b for a in self.strings for b in strings}

    def unknown(self, query=ALL) -> None:
        self.cut(False)
        self.found.append(query)


def _read(tree, flags: int) -> tuple[set[str] | None, tuple | str]:
    """The strings a parsed expression stands for, if they are few, and the query any match satisfies."""
    run = _Run()
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            made = _bytes(value, flags)
            run.extend({made}) if made is not None else run.unknown()
        elif name == "IN":
            members = _members(value, flags)
            run.extend(members) if members else run.unknown()
        elif name == "SUBPATTERN":
            _, added, removed, inner = value
            strings, query = _read(inner, (flags | added) & ~removed)
            run.extend(strings) if strings is not None else run.unknown(query)
        elif name == "BRANCH":
            parts = [_read(part, flags) for part in value[1]]
            if all(strings is not None for strings, _ in parts):
                run.extend(set().union(*[strings for strings, _ in parts]))
            else:
                run.unknown(either(query for _, query in parts))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            strings, query = _read(inner, flags)
            if strings is None or (least, most) == (0, 0):
                run.unknown(query if least else ALL)
            elif (least, most) == (0, 1):
                run.extend(strings | {""})
            else:
                for _ in range(min(int(least), 3)):
                    run.extend(strings)
                if least != most or least > 3:
                    run.unknown()
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):  # those take no characters
            run.unknown()
    query = every([*run.found, _contains(run.strings)])
    return (run.strings if run.whole else None), query


def trigram_query(pattern: str, flags: int = 0) -> tuple | str:
    """What any match of the expression must contain."""
    tree = re._parser.parse(pattern, flags)
    return _read(tree, tree.state.flags)[1]


def trigrams(query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


# ---------------------------------------------------------------- index


class Index:
    """Postings of the trigrams that the queries name, for one segment at a time."""

    def __init__(self, queries: Sequence):
        names = sorted(set().union(*map(trigrams, queries)))
        self.slots = {name: i for i, name in enumerate(names, 1)}
        self.table = np.zeros(1 << 24, np.uint16)  # a trigram's slot
        for name, slot in self.slots.items():
            a, b, c = name.encode("latin-1")
            self.table[a << 16 | b << 8 | c] = slot
        self.postings: dict[int, np.ndarray] = {}
        self.rows = 0

    def fill(self, texts: list[bytes]) -> None:
        """Index a segment. Zero bytes between texts belong to no trigram of a query."""
        self.rows = len(texts)
        data = np.frombuffer(b"\0\0".join(texts), np.uint8)
        starts = np.cumsum([0, *[len(t) + 2 for t in texts[:-1]]])
        keys = [np.zeros(0, np.int64)]
        for begin in range(0, len(data), PART_BYTES):
            part = data[begin : begin + PART_BYTES + 2].astype(np.uint32)
            slots = self.table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
            places = np.flatnonzero(slots)
            rows = np.searchsorted(starts, places + begin, "right") - 1
            keys.append(np.unique(slots[places].astype(np.int64) << 32 | rows))
        found = np.unique(np.concatenate(keys))
        slots, rows = found >> 32, found & 0xFFFFFFFF
        edges = np.searchsorted(slots, np.arange(len(self.slots) + 2))
        self.postings = {s: rows[edges[s] : edges[s + 1]] for s in self.slots.values()}

    def search(self, query) -> np.ndarray:
        """Rows of the segment that satisfy the query, sorted."""
        if isinstance(query, str):
            return self.postings[self.slots[query]]
        found = [self.search(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        if not found:
            return np.arange(self.rows)
        return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sorted(found, key=len))


class Scanner:
    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(rule, re.compile(rule.pattern), trigram_query(rule.pattern)) for rule in rules]
        self.index = Index([query for _, _, query in self.rules])

    def scan(self, texts: list[str | None]) -> list[list[tuple]]:
        """Spans of each text, (kind, start, end, base) by start and rule."""
        out, segment, held = [], [], 0
        for text in texts:
            size = len(text or "")
            if segment and held + size > SEGMENT_BYTES:
                out += self._segment(segment)
                segment, held = [], 0
            segment.append(text or "")
            held += size
        return out + self._segment(segment)

    def _segment(self, texts: list[str]) -> list[list[tuple]]:
        found: list[list[tuple]] = [[] for _ in texts]
        self.index.fill([t.encode().lower() for t in texts])
        for order, (rule, regex, query) in enumerate(self.rules):
            for row in self.index.search(query).tolist():
                for match in regex.finditer(texts[row]):
                    start, end = match.span(rule.group)
                    if end - start >= rule.least:
                        found[row].append((match.start(), order, match.end()))
        return [self._spans(spans) for spans in found]

    def _spans(self, spans: list[tuple[int, int, int]]) -> list[tuple]:
        """Sorted, added spans only where no base span lies."""
        spans.sort()
        rules = [rule for rule, _, _ in self.rules]
        base = [(start, end) for start, order, end in spans if rules[order].base]
        starts, ends = [start for start, _ in base], list(accumulate((end for _, end in base), max))

        def free(start: int, end: int) -> bool:
            before = bisect_left(starts, end)
            return not before or ends[before - 1] <= start

        return [(rules[o].kind, start, end, rules[o].base) for start, o, end in spans if rules[o].base or free(start, end)]


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and the ``spans`` of each row, with kind, start, end (code points, end exclusive) and base."""
    rules = tuple(rules)

    def make() -> Callable:
        scanner = worker_cache(f"secrets:{rules}", lambda: Scanner(rules))
        return lambda texts: [scanner.scan(texts)]

    return map_texts(docs, keys, F.col(text), SPANS, make)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and ``redacted``, the text with each secret replaced by its kind in brackets; overlapping ones become the first."""
    rules = tuple(rules)

    def make():
        scanner = worker_cache(f"secrets:{rules}", lambda: Scanner(rules))

        def hide(value, spans):
            out, at = [], 0
            for kind, start, end, _ in spans:
                if start >= at:
                    out += [value[at:start], f"[{kind}]"]
                at = max(at, end)
            return "".join([*out, value[at:]])

        return lambda texts: [[None if t is None else hide(t, s) for t, s in zip(texts, scanner.scan(texts))]]

    return map_texts(docs, keys, F.col(text), "redacted string", make)
