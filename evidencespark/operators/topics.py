"""HTML topics: decoded pages, their content blocks, and the blocks under their headings with line numbers."""

from __future__ import annotations

import posixpath
import re
from html.parser import HTMLParser
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame

#: Elements and class names that are never content, elements that hold it, and those that end a block.
DROPPED = frozenset("script style noscript template nav aside footer".split())
DROPPED_NAMES = frozenset("nav navigation navbar menu sidebar toc breadcrumb breadcrumbs footer".split())
CONTENT = frozenset(["main", "article"])
ENDS_BLOCK = frozenset("p div section article main ul ol li dl dt dd table tr td th pre blockquote h1 h2 h3 h4 h5 h6 header body html br hr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CHARSET = re.compile(rb"<meta[^>]{0,400}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.I)


def decoded(raw: bytes) -> str:
    """The text of a page: by the charset it declares in its first 8 KiB, else UTF-8, else Windows-1252."""
    found = _CHARSET.search(raw[:8192])
    declared = found[1].decode("ascii") if found else None
    for name in [*([declared] if declared else []), "utf-8-sig", "cp1252"]:
        try:
            return raw.decode(name).lstrip("\ufeff")
        except (UnicodeDecodeError, LookupError):
            continue
    try:
        return raw.decode(declared or "utf-8", errors="replace")
    except LookupError:
        return raw.decode("utf-8", errors="replace")


def topic_path(path: str) -> str | None:
    """A topic's path in one form (decoded, with slashes, without dots), or None if it leaves the archive or is no page."""
    path = unquote(path.split("#")[0].split("?")[0]).replace("\\", "/").lstrip("/")
    if not path or "\0" in path or re.match(r"[A-Za-z]:", path) or ".." in path.split("/"):
        return None
    path = posixpath.normpath(path)
    return path if path.lower().endswith((".htm", ".html", ".xhtml")) else None


class _Blocks(HTMLParser):
    """Collects ``(level, anchor, text, in content)`` of each block; level 0 is a paragraph."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, str, str, bool]] = []
        self.open: list[tuple[str, bool, bool]] = []  # tag, dropped, content
        self.parts: list[str] = []
        self.level, self.anchor = 0, ""

    def _state(self) -> tuple[bool, bool]:
        return self.open[-1][1:] if self.open else (False, False)

    def _end(self) -> None:
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\n")) if self.level == -1 else [" ".join("".join(self.parts).split())]
        text = "\n".join(x for x in lines if x)
        if text:
            self.blocks.append((max(self.level, 0), self.anchor, text, self._state()[1]))
        self.parts, self.level, self.anchor = [], 0, ""

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag in ENDS_BLOCK:
            self._end()
        dropped, content = self._state()
        if tag in VOID:
            return
        names = set(re.split(r"[\s_-]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
        dropped |= tag in DROPPED or not DROPPED_NAMES.isdisjoint(names)
        content |= tag in CONTENT or attrs.get("role", "").lower() == "main"
        self.open.append((tag, dropped, content))
        if re.fullmatch("h[1-6]", tag):
            self.level, self.anchor = int(tag[1]), attrs.get("id") or attrs.get("name") or ""
        elif tag == "pre":
            self.level = -1
        elif tag == "a" and self.level > 0 and not self.anchor:
            self.anchor = attrs.get("name") or attrs.get("id") or ""

    def handle_endtag(self, tag):
        if tag in ENDS_BLOCK:
            self._end()
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if not self._state()[0]:
            self.parts.append(data)


def blocks_of(html: str) -> list[tuple[int, str, str]]:
    """``(level, anchor, text)`` of the content blocks: those inside of main or article if the page has any there."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser._end()
    inside = [b[:3] for b in parser.blocks if b[3]]
    return inside or [b[:3] for b in parser.blocks]


def markdown_of(blocks: list[tuple[int, str, str]]) -> str:
    """The page as Markdown: headings by level, and no first paragraph that repeats its heading."""
    out = []
    for i, (level, _, text) in enumerate(blocks):
        if not level and i and blocks[i - 1][0] and blocks[i - 1][2].casefold() == text.casefold():
            continue
        out.append("#" * min(max(level, 1), 6) + " " + text if level else text)
    return "\n\n".join(out)


def sections_of(blocks: list[tuple[int, str, str]]) -> list[tuple[str, str, int, int, str]]:
    """``(heading path, anchor, first line, last line, text)``: the paragraphs under each heading; a block takes two lines."""
    stack: list[tuple[int, str]] = []
    out, line = [], 1
    held, anchor, begin = [], "", 1

    def flush():
        if held:
            out.append((" > ".join(t for _, t in stack), anchor, begin, max(begin, line - 2), "\n\n".join(held)))

    for level, mark, text in blocks:
        if level:
            flush()
            held, anchor, begin = [], mark, line
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, text))
            line += 2
        else:
            held.append(text)
            line += 2 + text.count("\n")
    flush()
    return out


def html_topics(pages: DataFrame) -> DataFrame:
    """``(page_id, ordinal, heading_path, anchor, start_line, end_line, text)`` of ``pages(page_id, url, content)``.

    Pages do not depend on each other: one pass without a shuffle. Pages without content, and null ones, give no row.
    """

    def cut(frames):
        for frame in frames:
            rows = []
            for page_id, content in zip(frame["page_id"], frame["content"], strict=True):
                blocks = blocks_of(decoded(bytes(content))) if content is not None else []
                rows.extend((page_id, i, path, anchor, a, b, text) for i, (path, anchor, a, b, text) in enumerate(sections_of(blocks)))
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "heading_path", "anchor", "start_line", "end_line", "text"])

    return pages.select("page_id", "content").mapInPandas(cut, "page_id long, ordinal long, heading_path string, anchor string, start_line long, end_line long, text string")
