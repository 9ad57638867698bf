"""Main-text extraction from HTML by a minimum cut.

A page is cut into text blocks. A linear classifier on each block's containers, class names, links and wording
gives it a score: its cost of being left out (if positive) or kept (if negative). Blocks are nodes; the scores are
capacities from the source or to the sink, and blocks that follow each other or stand near each other in the
element tree are joined by edges whose capacity is the price of labelling them differently. The minimum cut, found
by augmenting paths, is the labelling of least total price; the source side is the main text.

Pages are independent: a table is one pass without a shuffle, and each page is read whole.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from evidencespark.llm.common import free_name

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title|head)\b(?![-:])[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I,
)
_ENDS = {t: re.compile(rf"</{t}\s*>" + (r"|(?=<body\b)" if t == "head" else ""), re.I) for t in "script style noscript template svg math iframe object canvas textarea select title head".split()}
_ATTR = re.compile(r"\b(class|id|role|itemprop|style|aria-hidden|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_BREAKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = _BREAKS - {"button", "label", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "summary", "legend"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"})} | {
    t: ({"td", "th"} | ({"tr"} if t == "tr" else set()), {"table"}) for t in ("td", "th", "tr")
}
_ANCHOR, _HREF = re.compile(r"<(/?)a(?![-\w:])", re.I), re.compile(r"\bhref\s*=", re.I)
_GOOD_TAGS = frozenset(["article", "main"])
_BAD_TAGS = frozenset("nav aside footer form menu dialog button fieldset label".split())
_GOOD_NAMES = frozenset("article articlebody body content entry main post story text".split())
_BAD_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments "
    "commentlist complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion disqus "
    "donate footer footnav form gdpr hidden legal login masthead menu menubar modal nav navbar navigation newsletter "
    "notice notices notification overlay pager pagination paywall popup promo promotion promoted related replies "
    "reply respond recommended search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe "
    "subscription tags teaser toolbar widget widgets".split()
)

#: Words that say of a name what state it is in ("comments-open", "has-sidebar"), not what it holds: at its begin, or at
#: the end of a name of two words.
_STATE_BEGINS = frozenset("has no with without".split())
_STATE_ENDS = frozenset("open opened closed enabled disabled on off active".split())
#: Bad words that weigh less beside a good one ("story-legal"), and one that weighs less by itself.
_SOFT_NAMES = frozenset("banner byline copyright disclaimer hidden legal masthead overlay paywall popup search social tags".split())
_MILD_NAMES = frozenset(["discussion"])
#: Last words of names that say nothing of what is held; after any other one a bad word is in doubt ("share-price").
_FRAME_NAMES = frozenset(
    "area bar block body box button buttons container content entry form group header holder icon icons inner item items label layer left link links list "
    "message module outer panel post posts right row section slot text thread title top unit wrap wrapper zone".split()
)
#: How far containers speak against main text: not, by a doubtful name, or plainly.
FINE, DOUBTFUL, BAD = 0, 1, 2

#: Weights of the block classifier.
GOOD_CONTAINER, DOUBTFUL_CONTAINER, BAD_CONTAINER, PAGE_HEADER, OUTSIDE = 3.0, -3.0, -8.0, -8.0, -3.0
WORDS, LINKS, SENTENCE, PARAGRAPH, HEADING, ITEM, RIGHTS, BIAS = 0.9, -4.0, 0.7, 0.8, 0.5, -0.3, -2.0, -2.0
#: With fewer plain words than this a page has nothing but short blocks, which then weigh more.
SHORT_PAGE, SHORT = 60, 1.5
#: Edge capacities: blocks that follow each other, further ones for a common parent, and across a boilerplate border.
NEXT, SAME_PARENT, BORDER = 0.6, 0.6, 0.1


class Block:
    """One run of text: its words, link letters, element, parent, depth, and what its containers say."""

    __slots__ = ("good", "header", "linked", "parent", "depth", "bad", "tag", "text")

    def __init__(self, text, linked, tag, parent, depth, good, bad, header):
        self.text, self.linked, self.tag, self.parent, self.depth = text, linked, tag, parent, depth
        self.good, self.bad, self.header = good, bad, header


def _named(attrs: str, holds_text: bool) -> tuple[bool, int]:
    """Whether class, id or role speak for main text, and how far they or hiding attributes speak against it.

    Names do not speak against an element that ``holds_text`` by its kind (article, main).
    """
    good, bad = False, FINE
    for key, value in _ATTR.findall(attrs):
        key = key.lower()
        value = value.strip("\"'")
        if key == "style":
            bad = max(bad, BAD * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)))
        elif key == "hidden":
            bad = max(bad, BAD * (value.lower() != "until-found"))
        elif key == "aria-hidden":
            bad = max(bad, BAD * (value.lower() == "true"))
        else:
            for name in value.split():
                words = [x.lower() for x in _NAME_PART.findall(name)] or [name.lower()]
                parts = {*words, name.lower()}
                well = not _GOOD_NAMES.isdisjoint(parts)
                good |= well
                against = parts & _BAD_NAMES
                state = words[0] in _STATE_BEGINS or (len(words) == 2 and words[1] in _STATE_ENDS)
                if against and not holds_text and not state:
                    other_end = words[-1] not in _BAD_NAMES and words[-1] not in _FRAME_NAMES and words[-1] not in _STATE_ENDS and name.lower() not in _BAD_NAMES
                    doubtful = other_end or (well and against <= _SOFT_NAMES) or parts <= _MILD_NAMES
                    bad = max(bad, DOUBTFUL if doubtful else BAD)
    return good and bad < BAD, bad


def blocks_of(html: str) -> list[Block]:
    """The text blocks of a page in page order; what is never text (head, scripts, styles, markup) is left out."""
    out: list[Block] = []
    # Open containers: (tag, number, good, bad, header); inherited flags are those of the container above or its own.
    stack = [("", 0, False, FINE, False)]
    count, in_link, unclosed = 0, False, False
    parts: list[str] = []
    linked = 0
    upto, n = 0, len(html)

    def flush():
        nonlocal linked, in_link
        if unclosed:  # such a link ends with its block
            in_link = False
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                tag, number, good, bad, header = stack[-1]
                parent = stack[-2][1] if len(stack) > 1 else 0
                out.append(Block(text, linked, tag, parent, len(stack), good, bad, header))
            parts.clear()
            linked = 0

    def add(raw):
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text)

    while upto < n:
        m = _TOKEN.search(html, upto)
        if m is None:
            add(html[upto:])
            break
        if m.start() > upto:
            add(html[upto : m.start()])
        upto = m.end()
        if m[1]:
            end = _ENDS[m[1].lower()].search(html, upto)
            upto = end.end() if end else n
            if m[1].lower() in ("head", "title"):
                flush()
            continue
        name = m[3] or m[6]
        if not name:
            continue
        tag, closing, attrs = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing and _HREF.search(attrs) is not None
            after = _ANCHOR.search(html, upto) if in_link else None
            unclosed = in_link and (after is None or not after[1])
        if tag not in _BREAKS and not (attrs and not closing and _named(attrs, False)[1]) and not (closing and any(x[0] == tag for x in stack)):
            continue
        if tag in ("br", "img", "input", "hr", "wbr", "a", "meta", "link", "embed", "source", "col", "area"):
            if tag == "hr":
                flush()
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in _CLOSES_P and stack[-1][0] in ("p", *(_HEADINGS if tag in _HEADINGS else ())):
            stack.pop()
        elif tag in _SIBLINGS:
            same, scope = _SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in scope:
                    break
                if stack[i][0] in same:
                    del stack[i:]
                    break
        _, _, good, bad, header = stack[-1]
        own_good, own_bad = _named(attrs, tag in _GOOD_TAGS) if attrs else (False, FINE)
        if tag == "header" and good:
            own_bad = FINE
        if tag in ("html", "body"):
            own_good, own_bad = False, FINE
        count += 1
        stack.append(
            (tag, count, good or own_good or tag in _GOOD_TAGS, max(bad, own_bad, BAD * (tag in _BAD_TAGS)), header or (tag == "header" and not good))
        )
        if attrs.endswith("/") and tag not in _BREAKS:
            stack.pop()
    flush()
    return out


def block_scores(blocks: list[Block]) -> list[float]:
    """The classifier: above 0 for main text, below for boilerplate; the distance is the cost of the other label."""
    some_good = any(b.good and not b.bad for b in blocks)
    plain = [not b.bad and not b.header and 2 * b.linked < len(b.text) for b in blocks]
    short = sum(b.text.count(" ") + 1 for b, p in zip(blocks, plain, strict=True) if p) < SHORT_PAGE
    scores = []
    for b, p in zip(blocks, plain, strict=True):
        words = b.text.count(" ") + 1
        z = BIAS + WORDS * log1p(words) + LINKS * min(1.0, b.linked / len(b.text))
        if b.text[-1] in ".!?…\"”»:;":
            z += SENTENCE
        if b.tag == "p" or b.tag == "blockquote" or b.tag == "pre":
            z += PARAGRAPH
        elif b.tag in _HEADINGS:
            z += HEADING
        elif b.tag in ("li", "td", "th", "dd", "dt", "option"):
            z += ITEM
        if "©" in b.text and not b.good:
            z += RIGHTS
        if b.good:
            z += GOOD_CONTAINER
        elif some_good:
            z += OUTSIDE
        z += (0.0, DOUBTFUL_CONTAINER, BAD_CONTAINER)[b.bad]
        if b.header:
            z += PAGE_HEADER
        if short and p:
            z += SHORT
        scores.append(z)
    return scores


def block_edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block with the next one, and with the last one before it under the same parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        before = last.get(b.parent)
        if i:
            a = blocks[i - 1]
            if (a.bad, a.header) != (b.bad, b.header):
                edges.append((i - 1, i, BORDER))
            else:
                edges.append((i - 1, i, NEXT / (1 + abs(a.depth - b.depth)) + (SAME_PARENT if before == i - 1 else 0)))
        if before is not None and before < i - 1:
            a = blocks[before]
            edges.append((before, i, SAME_PARENT if (a.bad, a.header) == (b.bad, b.header) else BORDER))
        last[b.parent] = i
    return edges


def source_side(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut of the graph in which a positive score is a capacity from the source, a negative one to the sink.

    Each positive node sends flow along shortest augmenting paths to nodes that can still drain. A search that
    finds none has met a closed set of the residual graph: its nodes are on the source side for good.
    """
    n = len(scores)
    left = list(scores)
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        room[a][b] = room[a].get(b, 0.0) + c
        room[b][a] = room[b].get(a, 0.0) + c
    kept = [False] * n
    for s in range(n):
        while left[s] > 1e-12 and not kept[s]:
            came, queue, end = {s: s}, deque([s]), -1
            while queue and end < 0:
                a = queue.popleft()
                for b, c in room[a].items():
                    if c > 1e-12 and b not in came and not kept[b]:
                        came[b] = a
                        if left[b] < -1e-12:
                            end = b
                            break
                        queue.append(b)
            if end < 0:
                for a in came:
                    kept[a] = True
                break
            path = [end]
            while path[-1] != s:
                path.append(came[path[-1]])
            path.reverse()
            flow = min(left[s], -left[end], *(room[a][b] for a, b in zip(path[:-1], path[1:], strict=True)))
            left[s] -= flow
            left[end] += flow
            for a, b in zip(path[:-1], path[1:], strict=True):
                room[a][b] -= flow
                room[b][a] = room[b].get(a, 0.0) + flow
    return kept


def main_text(html: str | None) -> tuple[str, int, int]:
    """The main text of a page (its blocks joined by one line feed), its number of blocks and of those kept."""
    blocks = blocks_of(html or "")
    kept = source_side(block_scores(blocks), block_edges(blocks))
    texts = [b.text for b, k in zip(blocks, kept, strict=True) if k]
    return "\n".join(texts), len(blocks), len(texts)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` with ``text``, ``n_blocks`` and ``n_kept`` of the main text of ``html_col``.

    A null or empty page, or one without main text, has the empty text. Each row is extracted on its own: repeated
    rows, null ids and further columns do not matter (a clashing column stays; the new one gets underscores before
    its name), and an empty table stays empty.
    """
    at = pages.columns.index(html_col)
    new = [free_name(pages, c) for c in ("text", "n_blocks", "n_kept")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(x) for x in batch.column(at).to_pylist()]
            columns = [pa.array([x[0] for x in got], pa.string()), *(pa.array([x[i] for x in got], pa.int32()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new])

    kinds = (StringType(), IntegerType(), IntegerType())
    fields = [StructField(c, k, False) for c, k in zip(new, kinds, strict=True)]
    return pages.mapInArrow(run, StructType([*pages.schema.fields, *fields]))
