"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

The base patterns find what is certain. Candidates are the base spans and near misses: parts of longer runs of digits,
numbers that fail a check, addresses with a spelled-out sign, addresses of the longer IP form, numbers in national
form. Five labelers (shape, check digits and ranges, gazetteer, context, boundary) vote yes, no or nothing on
each. Votes and coarse features make a small code, so the corpus becomes one count per kind and code. On these counts
expectation-maximisation estimates the labelers' reliabilities, and a logistic classifier is trained on its
posteriors. Candidates it accepts are added; base spans always stay.

Texts are scanned whole, offsets count code points. Null text has no spans; ids may be null or repeated; further columns
are ignored; empty tables work (nothing is accepted beyond the base).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("shape", "check", "gazetteer", "context", "boundary")
NONE, NO, YES = 0, 1, 2
ACCEPT = 0.9

# Before any data: how often each labeler says nothing, no, yes of true spans and of others.
PRIOR = np.array([
    [[0.20, 0.10, 0.70], [0.30, 0.30, 0.40]],
    [[0.02, 0.02, 0.96], [0.08, 0.86, 0.06]],
    [[0.10, 0.10, 0.80], [0.20, 0.50, 0.30]],
    [[0.60, 0.05, 0.35], [0.60, 0.30, 0.10]],
    [[0.02, 0.08, 0.90], [0.02, 0.58, 0.40]],
])
PRIOR_WEIGHT = 0.25  # of the corpus's candidates, 20 at least

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The look-behind changes no match: a failing run of digits fails from each of its digits.
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SPELLED_AT = re.compile(r"\s?[(\[{]\s?at\s?[)\]}]\s?", re.I)
SPELLED_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\.)[A-Za-z0-9-]{1,63})+", re.I)
LONG_ADDRESS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
PLUS_PART = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9.])")
NATIONAL = re.compile(r"(?<![\w+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\w-])")
GROUP = re.compile(r"[0-9]+")

TOP_LEVELS = frozenset("com org net edu gov int info biz io co de fr es it nl uk ch at be pt pl eu us ca au jp".split())
GOOD_WORDS = (
    ("mail", "contact", "write to", "correo", "courriel", "kontakt"),
    ("ip", "address", "host", "server", "adresse", "logged in from"),
    ("card", "visa", "master", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    ("phone", "tel", "call", "mobile", "fax", "cell", "anruf", "appel", "llama"),
)
BAD_WORDS = ("version", "token", "isbn", "order", "sku", "serial", "hash", "key", "license", "licence", "release", "build")


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of the base pattern, found from each @ outwards so that long runs cost no more than their length."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                last = domain.end()
                found.append((start, last))
        at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in text.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Per kind the spans of the base patterns, and the matches that failed a check."""
    good: list[list[tuple[int, int]]] = [emails(text), [], [], []]
    failed: list[list[tuple[int, int]]] = [[], [], [], []]
    for m in ADDRESS.finditer(text):
        (good if _octets(m[0]) else failed)[IP].append(m.span())
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if len(digits) >= 14:
                (good if len(digits) <= 19 and luhn(digits) else failed)[CARD].append(m.span())
    if "+" in text:
        for m in PLUS.finditer(text):
            (good if 10 <= len(_digits(m[0])) <= 15 else failed)[PHONE].append(m.span())
    return good, failed


def near_misses(text: str, failed: list[list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """Candidates beyond the base: kind, start, end."""
    found = [(IP, *span) for span in failed[IP]]
    for start, end in failed[CARD]:
        groups = [(start + m.start(), start + m.end()) for m in GROUP.finditer(text[start:end])]
        i = 0
        while i < len(groups):  # the longest run of whole groups that passes, else the group itself
            taken = i + 1
            for j in range(min(len(groups), i + 8), i, -1):
                digits = _digits(text[groups[i][0] : groups[j - 1][1]])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((CARD, groups[i][0], groups[j - 1][1]))
                    taken = j
                    break
            else:
                if 14 <= groups[i][1] - groups[i][0] <= 19:
                    found.append((CARD, *groups[i]))
            i = taken
    for start, end in failed[PHONE]:
        found += [(PHONE, start + m.start(), start + m.end()) for m in PLUS_PART.finditer(text[start:end])]
    if "(" in text or "[" in text or "{" in text:
        for m in SPELLED_AT.finditer(text):
            local = SPELLED_LOCAL.search(text[max(0, m.start() - 64) : m.start()])
            domain = SPELLED_DOMAIN.match(text, m.end())
            if local and domain:
                found.append((EMAIL, m.start() - len(local[0]), domain.end()))
    if text.count(":") >= 7:
        found += [(IP, *m.span()) for m in LONG_ADDRESS.finditer(text)]
    found += [(PHONE, *m.span()) for m in NATIONAL.finditer(text)]
    return found


def _gazetteer(kind: int, part: str, digits: str) -> int:
    if kind == EMAIL:
        return YES if re.split(r"\.|\s", re.sub(r"[)\]}]", "", part))[-1].lower() in TOP_LEVELS else NO
    if kind == IP:
        if ":" in part:
            return YES if part[:1] in "23fF" else NONE
        first = part.split(".")[0][-4:]
        return YES if 1 <= int(first) <= 223 and int(first) != 127 else NO
    if kind == CARD:
        return YES if digits[0] in "3456" else NO
    return YES if digits[0] != "0" else NO


def votes(text: str, kind: int, start: int, end: int, base: bool) -> int:
    """The labelers' votes and coarse features of a candidate as one number."""
    part = text[start:end]
    digits = _digits(part)
    compact = part.isdigit()
    shape = YES if base or compact or (kind == CARD and re.fullmatch(r"[0-9]{4}([ -][0-9]{4}){3}", part)) else NONE
    if kind == CARD:
        check = YES if 14 <= len(digits) <= 19 and luhn(digits) else NO
    elif kind == IP:
        check = YES if ":" in part or _octets(part) else NO
    elif kind == PHONE:
        check = YES if 10 <= len(digits) <= 15 else NO
    else:
        check = YES if re.search(r"[A-Za-z]{2,}\Z", part) else NO
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 20].lower()
    context = NONE
    if any(word in before or word in after for word in BAD_WORDS):
        context = NO
    elif any(re.search(rf"\b{word}", before) for word in GOOD_WORDS[kind]):
        context = YES
    edge = text[start - 1 : start] + text[end : end + 1]
    boundary = NO if any(c.isalnum() or c in "\"'_/=" for c in edge) else YES
    code = 0
    for vote in (shape, check, _gazetteer(kind, part, digits), context, boundary):
        code = code * 3 + vote
    spread = len(set(digits)) > 4
    return (code * 4 + min(3, len(part) // 8)) * 2 + spread


def scan(text: str | None, accepted: frozenset[tuple[int, int]] | None = None) -> list[tuple[int, int, int, bool, int]]:
    """Spans of one text: kind, start, end, base, code. With ``accepted`` only the base and accepted ones."""
    if not text:
        return []
    good, failed = base_spans(text)
    spans = [(kind, s, e, True, votes(text, kind, s, e, True)) for kind in range(4) for s, e in good[kind]]
    taken = [list(own) for own in good]
    for kind, s, e in sorted(near_misses(text, failed), key=lambda c: (c[0], c[1], -c[2])):
        if any(s < b and a < e for a, b in taken[kind][-1:]) or any(s < b and a < e for a, b in good[kind]):
            continue
        code = votes(text, kind, s, e, False)
        if accepted is None or (kind, code) in accepted:
            taken[kind].append((s, e))
            spans.append((kind, s, e, False, code))
    return sorted(spans, key=lambda x: (x[1], x[0], x[2]))


def redact(text: str | None, spans: Sequence[tuple[int, int, int, bool, int]]) -> str | None:
    """The text with every span replaced by its kind; spans that overlap become one."""
    if not spans:
        return text
    out, place, covered = [], 0, 0
    for kind, start, end, *_ in spans:
        if start >= covered:
            out += [text[place:start], f"<{KINDS[kind].upper()}>"]
        covered = max(covered, end)
        place = covered
    return "".join(out) + text[place:]


SPANS = "spans array<struct<kind:int,start:int,end:int,base:boolean,code:int>>"


def _as_dicts(spans):
    return [{"kind": k, "start": s, "end": e, "base": b, "code": c} for k, s, e, b, c in spans]


def _unpack(code: int) -> tuple[list[int], int, int]:
    code, spread = divmod(code, 2)
    code, size = divmod(code, 4)
    found = []
    for _ in LABELERS:
        code, vote = divmod(code, 3)
        found.append(vote)
    return found[::-1], size, spread


def reliabilities(ballots: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: posteriors, P(vote | labeler, class) with class 0 true, and the share of true spans."""
    strength = max(20.0, PRIOR_WEIGHT * weights.sum())
    table, share = PRIOR.copy(), 0.5
    labeler = np.arange(len(LABELERS))
    post = np.zeros(len(ballots))
    for _ in range(rounds):
        logs = np.log(table[labeler, :, ballots]).sum(axis=1) + np.log([share, 1 - share])
        new = 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -500, 500)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        if done:
            break
        for which, mass in ((0, weights * post), (1, weights * (1 - post))):
            counts = strength * PRIOR[:, which, :]
            for vote in range(3):
                counts[:, vote] += mass @ (ballots == vote)
            table[:, which, :] = counts / counts.sum(axis=1, keepdims=True)
        share = (weights @ post + 10) / (weights.sum() + 20)
    return post, table, share


def classifier(features: np.ndarray, target: np.ndarray, weights: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Probabilities of a ridge logistic fit to soft targets, by Newton steps."""
    beta = np.zeros(features.shape[1])
    scale = weights * (1000 / max(1000.0, weights.sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        slope = features.T @ (scale * (target - p)) - ridge * beta
        bend = (features * (scale * p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(beta))
        step = np.linalg.solve(bend, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))


def fit(docs: DataFrame, text: str = "text") -> frozenset[tuple[int, int]]:
    """Kind and code of the candidates to accept, learned from all documents.

    What reaches the driver is one count per kind and code, at most 4 x 1,944 numbers at any size of the corpus.
    """

    def make():
        return lambda texts: [[_as_dicts(scan(t)) for t in texts]]

    found = map_texts(docs, [], F.col(text), SPANS, make).select(F.explode("spans").alias("s"))
    counts = found.groupBy("s.kind", "s.code").agg(F.count("*").alias("n")).collect()
    accepted = set()
    for kind in range(len(KINDS)):
        rows = sorted((r.code, r.n) for r in counts if r.kind == kind)
        if not rows:
            continue
        parts = [_unpack(code) for code, _ in rows]
        ballots, weights = np.array([p[0] for p in parts]), np.array([n for _, n in rows], float)
        post, _, _ = reliabilities(ballots, weights)
        features = np.column_stack([
            np.ones(len(rows)), *[(ballots == vote).astype(float)[:, i] for i in range(len(LABELERS)) for vote in (NO, YES)],
            *[[float(p[1] == size) for p in parts] for size in range(4)], [float(p[2]) for p in parts],
        ])
        chance = classifier(features, post, weights)
        accepted |= {(kind, code) for (code, _), c, q in zip(rows, chance, post) if c >= ACCEPT and q >= 0.5}
    return frozenset(accepted)


def detect(docs: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text", redacted: bool = False) -> DataFrame:
    """``keys`` and ``spans`` of each row, with ``redacted`` also the text without them. Reads the documents twice."""
    accepted = fit(docs, text)

    def make():
        def work(texts):
            found = [scan(t, accepted) for t in texts]
            out = [[_as_dicts(spans) for spans in found]]
            return [*out, [redact(t, spans) for t, spans in zip(texts, found)]] if redacted else out

        return work

    return map_texts(docs, keys, text, SPANS + (", redacted string" if redacted else ""), make)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
