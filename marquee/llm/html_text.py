"""Main text of web pages by line-block distribution.

Markup is stripped: every block-level tag ends a line, and whatever is not content (scripts, styles, menus, headers,
footers, sidebars, notices, adverts, forms, reader comments) is taken out without a gap. Text lengths are summed over
sliding windows of lines. Where the sums rise from zero is a surge point, where they fall back a dive point; the lines between
them are kept if a sum reaches ``SURGE``. The lengths leave out links, but not in article and main elements, of which a page
may have any number; gaps of empty lines set these apart. Shorter stretches stay beside kept ones, so do single lines of
links between kept ones; a page with short stretches only keeps these. Lists of links outside articles and short stretches
among them are dropped.

Null html is the empty page; a page without text gives the empty string. Nothing is cut from long pages. Ids may be null
or repeated, further columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import map_texts

WINDOW = 3
# Characters of a window from which on a stretch is text by itself.
SURGE = 40
LINK_SHARE = 0.6

RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|canvas|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-zA-Z][^>]*+>")
ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|\b(hidden)\b", re.I)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SKIPPED = frozenset("head title nav footer aside form menu dialog button select fieldset object audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent"
    r"|notices?|alerts?|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|disqus|replies|respond|widget"
    r"|toolbar|pagination|pager|login|signup|search|copyright|skip)(?:$|[\s_-])",
    re.I,
)
PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|topbar)(?:$|[\s_-])", re.I)


def _furniture(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is not content."""
    if name in SKIPPED or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "article", "main") and not re.search("comment", attributes, re.I):
        return False
    for key, value, hidden in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        key = key.lower()
        if hidden or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id") and (FURNITURE.search(value) or (not in_article and PAGE_HEADER.search(value))):
            return True
    return False


def _end_of(tags: list[re.Match], at: int) -> int:
    """Index of the tag that closes the element opened at ``at``; without one, that of the next block's start."""
    name, depth = tags[at][2].lower(), 0
    for i in range(at, len(tags)):
        if tags[i][2] and tags[i][2].lower() == name:
            depth += -1 if tags[i][1] else not tags[i][3].endswith("/")
            if depth == 0:
                return i
    return next((i - 1 for i in range(at + 1, len(tags)) if tags[i][2] and tags[i][2].lower() in BLOCKS), len(tags) - 1)


def lines(page: str) -> list[tuple[str, int, int]]:
    """Lines of a page without markup: text, characters in links, number of the article around it (0: none)."""
    page = RAW.sub(" <hr> ", page)
    tags = list(TAG.finditer(page))
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    linked = article = articles = depth = in_link = 0
    place = i = 0

    def end_line():
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        out.append((text, min(linked, len(text)), article))
        linked = 0

    while i < len(tags):
        tag = tags[i]
        text = page[place : tag.start()]
        held.append(text)
        linked += len(text) if in_link else 0
        place = tag.end()
        name = (tag[2] or "").lower()
        if name and not tag[1] and name not in VOID and _furniture(name, tag[3] or "", article > 0):
            end_line()
            i = _end_of(tags, i)
            place = tags[i].end()
        elif name == "br":
            held.append(" ")
        elif name == "a":
            in_link = not tag[1]
        elif name in BLOCKS:
            end_line()
            if name in ("article", "main"):
                if not tag[1]:
                    depth += 1
                    if depth == 1:
                        articles += 1
                        article = articles
                elif depth:
                    depth -= 1
                    article = article if depth else 0
                out.extend([("", 0, 0)] * WINDOW)
        i += 1
    held.append(page[place:])
    end_line()
    return out


def weights(rows: Sequence[tuple[str, int, int]]) -> list[int]:
    """Length of each line: all its characters in an article, elsewhere those outside links, none for a line of links."""
    out = []
    for text, linked, article in rows:
        plain = len(text) - linked
        out.append(len(text) if article else 0 if linked > LINK_SHARE * len(text) and plain < SURGE else plain)
    return out


def stretches(lengths: Sequence[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Surge point, dive point (exclusive) and peak of each stretch of lines with text."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    found, start = [], None
    for i, total in enumerate([*sums, 0]):
        if total and start is None:
            start = i
        elif not total and start is not None:
            found.append((start, i, max(sums[start:i])))
            start = None
    return found


def kept_lines(rows: Sequence[tuple[str, int, int]]) -> list[int]:
    """Numbers of the lines with text that are main text."""
    lengths = weights(rows)
    # Runs of lines in page order: a stretch from its first to its last line with length, or the line of links between two.
    runs: list[tuple[str, list[int]]] = []

    def links(start: int, end: int):
        found = [i for i in range(start, end) if rows[i][0]]
        if found:
            runs.append(("links", found))

    place = 0
    for start, end, peak in stretches(lengths):
        held = [i for i in range(start, end) if lengths[i]]
        links(place, held[0])
        place = held[-1] + 1
        runs.append(("text" if peak >= SURGE else "short", [i for i in range(held[0], place) if rows[i][0]]))
    links(place, len(rows))
    kinds = [kind for kind, _ in runs]
    if "text" not in kinds:
        return [i for kind, found in runs if kind == "short" for i in found]
    keep = [kind == "text" for kind in kinds]
    # Short stretches beside kept ones, from the front and from the back.
    for order in (range(1, len(runs)), range(len(runs) - 2, -1, -1)):
        for i in order:
            keep[i] |= kinds[i] == "short" and keep[i - order.step]
    # A single line of links within the text is a sentence of it, several are a list of links.
    for i in range(1, len(runs) - 1):
        keep[i] |= kinds[i] == "links" and len(runs[i][1]) == 1 and keep[i - 1] and keep[i + 1]
    return [i for (_, found), kept in zip(runs, keep) if kept for i in found]


def main_text(page: str | None) -> str:
    """Main text of one page, a line for each block."""
    if not page:
        return ""
    rows = lines(page)
    return "\n".join(rows[i][0] for i in kept_lines(rows))


def extract(pages: DataFrame, keys: Sequence[str] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """``keys``, ``text`` and ``n_chars`` (code points) of each page."""

    def make():
        def work(pages):
            texts = [main_text(p) for p in pages]
            return [texts, [len(t) for t in texts]]

        return work

    return map_texts(pages, keys, F.col(page), "text string, n_chars long", make)
