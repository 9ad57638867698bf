"""The layout of :mod:`layout` for words that come page by page, in a task's memory and without a shuffle.

A table is a dict of columns: numpy arrays, and ``text`` an Arrow array. Tables of words have (doc_id, page, nth, text, x0,
top, x1, bottom, font_size, bold) with whole pages, those of lines come by document and page. Patterns are Arrow's, which
has the engine that SQL has.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from evidencespark.operators import layout

Table = dict[str, np.ndarray | pa.Array]
BLANKS = " \t\n\r\f\x0b"
_NUMBER, _SPACES, _DIGITS, _PROSE = re.compile(layout.NUMBER, re.ASCII), re.compile(f"[{BLANKS}]+"), re.compile("[0-9]+"), re.compile(layout.PROSE)


def taken(table: Table, at: np.ndarray) -> Table:
    """The rows of ``table`` at ``at``, places or a mask."""
    at = np.flatnonzero(at) if at.dtype == bool else at
    return {c: v.take(pa.array(at)) if isinstance(v, pa.Array) else v[at] for c, v in table.items()}


def joined(tables: list[Table]) -> Table:
    if len(tables) == 1:
        return tables[0]
    return {c: pa.concat_arrays([t[c] for t in tables]) if isinstance(v, pa.Array) else np.concatenate([t[c] for t in tables]) for c, v in tables[0].items()}


def _first(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in one of ``columns``."""
    found = np.ones(len(columns[0]), bool)
    if len(found):
        found[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return found


def _before(values: np.ndarray) -> np.ndarray:
    """The value of the row before; the first row has its own."""
    return np.concatenate([values[:1], values[:-1]])


def _medians(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The median of each group; groups are numbered from 0."""
    ordered, sizes = values[np.lexsort((values, group))], np.bincount(group)
    begin = np.cumsum(sizes) - sizes
    return (ordered[begin + (sizes - 1) // 2] + ordered[begin + sizes // 2]) / 2


def _matches(text: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(text, pattern).to_numpy(zero_copy_only=False)


def _one_spaced(text: str) -> str:
    return _SPACES.sub(" ", text).strip(" ")


#: Pages of at most so many words go through their rows together, word by word; longer ones each for itself.
TOGETHER = 512


def rows_of_pages(tops: np.ndarray, sizes: np.ndarray, page: np.ndarray) -> np.ndarray:
    """:func:`layout.rows_of` of many pages; words come by (page, top, x0), pages are numbered from 0."""
    line, counts = np.zeros(len(page), np.int64), np.bincount(page)
    begin = np.cumsum(counts) - counts
    for at, n in zip(begin[counts > TOGETHER].tolist(), counts[counts > TOGETHER].tolist(), strict=True):
        line[at : at + n] = layout.rows_of(tops[at : at + n], sizes[at : at + n])
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] <= TOGETHER]  # those that have a k-th word come first
    if not len(order):
        return line
    begin, counts, most = begin[order], counts[order], layout.OPEN_ROWS
    near = np.maximum(layout.ROW_POINTS, sizes * layout.ROW_SIZES)
    held, length, median = np.zeros((most, len(order), counts[0])), np.zeros((most, len(order)), np.int64), np.zeros((most, len(order)))
    rows, back, left = np.zeros(len(order), np.int64), np.arange(most)[:, None], np.searchsorted(-counts, -np.arange(counts[0]))
    for k, n in enumerate(left.tolist()):  # ``n`` pages have more than ``k`` words
        at, own = begin[:n] + k, np.arange(n)
        last = rows[:n] - back
        fits = (last >= 1) & (np.abs(median[last % most, own] - tops[at]) <= near[at])
        new = ~fits.any(axis=0)
        rows[:n] += new
        hit = np.where(new, rows[:n], last[fits.argmax(axis=0), own])
        slot = hit % most
        size = np.where(new, 0, length[slot, own])
        held[slot, own, size], length[slot, own] = tops[at], size + 1
        median[slot, own] = (held[slot, own, size // 2] + held[slot, own, (size + 1) // 2]) / 2
        line[at] = hit
    return line


def lines(words: Table) -> Table:
    """:func:`layout.lines` of whole pages."""
    order = np.lexsort((words["nth"], words["x0"], words["top"], words["page"], words["doc_id"]))
    page = np.cumsum(_first(words["doc_id"][order], words["page"][order])) - 1
    line = rows_of_pages(words["top"][order], words["font_size"][order], page)
    by_place = np.lexsort((words["nth"][order], words["x0"][order], line, page))
    w, page, line = taken(words, order[by_place]), page[by_place], line[by_place]
    first, gap, last = _first(page, line), w["x0"] - _before(w["x1"]), _before(w["font_size"])
    wide = ~first & (gap > np.maximum(layout.CELL_POINTS, np.maximum(last, w["font_size"]) * layout.CELL_SIZES))
    tight = first | (gap <= 0) | _before(_matches(w["text"], "[ /-]$")) | _matches(w["text"], layout.TIGHT) | (_before(_matches(w["text"], f"{layout.CJK}$")) & _matches(w["text"], f"^{layout.CJK}"))
    marks = pa.array(["", "\t", " "]).take(pa.array(np.where(wide, 1, np.where(tight, 0, 2))))
    begin = np.flatnonzero(first)
    parts = pa.ListArray.from_arrays(pa.array(np.append(begin, len(first)), pa.int32()), pc.binary_join_element_wise(marks, w["text"], ""))
    found = {c: w[c][begin] for c in ("doc_id", "page")} | {"line": line[begin], "text": pc.utf8_trim(pc.binary_join(parts, ""), BLANKS)}
    if len(begin):
        found |= {"x0": np.minimum.reduceat(w["x0"], begin), "top": np.minimum.reduceat(w["top"], begin), "x1": np.maximum.reduceat(w["x1"], begin), "bottom": np.maximum.reduceat(w["bottom"], begin)}
        found |= {"font_size": _medians(w["font_size"], np.cumsum(first) - 1), "bold": np.logical_or.reduceat(w["bold"], begin), "columns": np.add.reduceat(wide.astype(np.int64), begin) + 1}
    else:
        found |= {c: w[c] for c in ("x0", "top", "x1", "bottom", "font_size", "bold")} | {"columns": line}
    return taken(found, pc.not_equal(found["text"], "").to_numpy(zero_copy_only=False))


def _page(table: Table) -> np.ndarray:
    """The number of each row's page within ``table``, from 0."""
    return np.cumsum(_first(table["doc_id"], table["page"])) - 1


def in_reading_order(rows: Table, width: float) -> Table:
    """:func:`layout.in_reading_order`; the rows come in that order."""
    rows = taken(rows, np.lexsort((rows["line"], rows["x0"], rows["top"], rows["page"], rows["doc_id"])))
    page, middle = _page(rows), width / 2
    x0, x1, enough = rows["x0"], rows["x1"], np.bincount(page)[page] >= 4
    barrier = (((x0 < middle) & (x1 > middle)) | (x1 - x0 >= width * layout.FULL_WIDTH)) & enough
    section = np.cumsum(barrier | _first(page)) - 1
    left = (x0 + x1) / 2 < middle
    counts = [np.bincount(section, ~barrier & side)[section] for side in (left, ~left)]
    column = np.where(barrier, -1, np.where((counts[0] >= 2) & (counts[1] >= 2) & enough & ~left, 1, 0))
    rows = taken(rows, np.lexsort((rows["line"], x0, rows["top"], column, section)))
    begin = np.flatnonzero(_first(page))
    return rows | {"position": np.arange(len(page)) - begin[page] + 1}


def printed_numbers(rows: Table, height: float) -> dict[int, tuple[int, str]]:
    """:func:`layout.printed_numbers`: of pages, by their number in the table, the place of the line and the number."""
    page, best = _page(rows), {}
    low = np.flatnonzero(rows["top"] >= height * layout.NUMBER_FROM)
    for at, text in zip(low.tolist(), rows["text"].take(pa.array(low)).to_pylist(), strict=True):
        number = _NUMBER.fullmatch(_one_spaced(text))
        if number:
            own = int(page[at])
            if own not in best or rows["top"][at] > rows["top"][best[own][0]]:
                best[own] = (at, number.group(1))
    return best


def marginal(rows: Table, height: float, ratio: float = layout.MARGIN) -> np.ndarray:
    """Which lines have a key in :func:`layout.margin_keys`, but for its length."""
    page = _page(rows)
    at_top = (rows["top"] <= height * ratio) & (rows["position"] <= 2)
    at_foot = (rows["bottom"] >= height * (1 - ratio)) & (rows["position"] >= np.bincount(page)[page] - 1)
    return (at_top | at_foot) & ~(at_top & (rows["font_size"] > _medians(rows["font_size"], page)[page] * layout.MARGIN_SIZE))


def visible(rows: Table, height: float) -> Table:
    """:func:`layout.visible` of whole documents."""
    kept, pages = np.ones(len(rows["page"]), bool), Counter(rows["doc_id"][_first(rows["doc_id"], rows["page"])].tolist())
    own = np.flatnonzero(marginal(rows, height))
    keys = [_DIGITS.sub("#", _one_spaced(t).lower()) for t in rows["text"].take(pa.array(own)).to_pylist()]
    found = list(zip(rows["doc_id"][own].tolist(), keys, strict=True))
    on_pages = Counter((doc, key) for doc, key, _ in {(*at, page) for at, page in zip(found, rows["page"][own].tolist(), strict=True)} if key and len(key) <= layout.LONGEST_MARGIN)
    repeated = [on_pages[at] >= max(layout.LEAST_PAGES, math.ceil(pages[at[0]] * layout.PAGE_SHARE)) for at in found]
    kept[own[np.array(repeated, bool)]] = False
    kept[[at for at, _ in printed_numbers(rows, height).values()]] = False
    return taken(rows, kept)


def documents(tables: Iterable[Table]) -> Iterator[Table]:
    """``tables`` cut anew, so that each has whole documents."""
    held: list[Table] = []
    for table in tables:
        begin = np.flatnonzero(_first(table["doc_id"]))
        if not len(begin):
            continue
        more = held and held[0]["doc_id"][0] == table["doc_id"][0]
        if len(begin) == 1 and more:
            held.append(table)
            continue
        ended = [*held, taken(table, np.arange(begin[-1]))] if begin[-1] else held
        if ended:
            yield joined(ended)
        held = [taken(table, np.arange(begin[-1], len(table["doc_id"])))]
    if held:
        yield joined(held)


KINDS = ("heading", "table", "list", "paragraph")


class Headings:
    """The headings that are open, while the pages of documents come one after the other."""

    def __init__(self):
        self.doc, self.titles = None, []

    def of(self, doc: int) -> list[str]:
        if doc != self.doc:
            self.doc, self.titles = doc, [None] * len(layout.HEADINGS)
        return self.titles

    def put(self, doc: int, level: int, text: str) -> None:
        self.of(doc)[level - 1 :] = [text, *[None] * (len(layout.HEADINGS) - level)]


def blocks(rows: Table, width: float, headings: Headings) -> list[tuple]:
    """:func:`layout.blocks` of whole pages in reading order; ``headings`` go on from one table to the next."""
    n = len(rows["page"])
    if not n:
        return []
    page, new, text = _page(rows), _first(rows["doc_id"], rows["page"]), rows["text"]
    body, plain, columns = _medians(rows["font_size"], page)[page], pc.utf8_trim(text, " "), rows["columns"]
    none = (pc.utf8_length(plain).to_numpy(zero_copy_only=False) > layout.LONGEST_HEADING) | (columns > 1) | _matches(plain, layout.LEADER) | _matches(plain, layout.TRIVIAL) | _matches(plain, layout.SENTENCE_END)
    ratio, level = rows["font_size"] / np.maximum(body, 1.0), np.where(rows["bold"], layout.HEADINGS[-1][1], 0)
    for least, depth in reversed(layout.HEADINGS):
        level[ratio >= least] = depth
    level[none] = 0
    tabular = columns >= 2
    run = np.cumsum(~tabular | new) - 1
    kind = np.where(tabular & (np.bincount(run, tabular)[run] >= 2), 1, np.where(_matches(text, layout.LIST_ITEM), 2, 3))
    kind[level > 0] = 0
    gap = rows["top"] - _before(rows["bottom"])
    opens = (kind > 0) & (new | (_before(kind) != kind) | (gap > np.maximum(layout.BLOCK_POINTS, body * layout.BLOCK_SIZES)))
    filled, ends = np.bincount(page, kind > 0)[page] > 0, np.append(new[1:], True)
    number = np.cumsum(opens)
    number -= (number - opens)[np.flatnonzero(new)][page]
    shown = text.to_pylist()
    for i in np.flatnonzero(kind == 1).tolist():
        shown[i] = "| " + " | ".join(c.strip(" ") for c in shown[i].split("\t")) + " |"
    stops = np.flatnonzero(opens | (kind == 0) | new)  # a block goes on up to the next of these
    following = dict(zip(stops.tolist(), [*stops[1:].tolist(), n], strict=True))
    begin = np.flatnonzero(opens)
    spans = np.stack([begin, [following[i] for i in begin.tolist()]], axis=1).ravel().astype(np.int64)
    over = lambda ufunc, c: ufunc.reduceat(np.append(rows[c], rows[c][-1:]), spans)[::2].tolist() if len(spans) else []
    boxes = dict(zip(begin.tolist(), zip(over(np.minimum, "x0"), over(np.minimum, "top"), over(np.maximum, "x1"), over(np.maximum, "bottom"), strict=True), strict=True))
    events = np.flatnonzero((level > 0) | opens)
    found, position = [], rows["position"].tolist()
    values = (c[events].tolist() for c in (rows["doc_id"], rows["page"], level, filled, ends, number, kind))
    for i, doc, own, depth, full, end_of_page, block, what in zip(events.tolist(), *values, strict=True):
        if depth:
            headings.put(doc, depth, shown[i])
            if full or not end_of_page:
                continue
        titles = [t for t in headings.of(doc) if t is not None]
        path = " > ".join(titles)
        if depth:
            block, content, start, end, box = 1, titles[-1], 1, 1, (0.0, 0.0, width, float(body[i]))
        else:
            to = following[i]
            content, start, end, box = "\n".join(shown[i:to]), position[i], position[to - 1], boxes[i]
        if path and not content.startswith(path):
            content = f"{path}\n\n{content}"
        found.append((doc, own, block, KINDS[what], path, content, "[%.2f,%.2f,%.2f,%.2f]" % box, start, end))
    return found


def displayed(text: str, heading_path: str) -> str:
    """:func:`layout.displayed` of one block."""
    rows = text.split("\n")
    first = next((i for i, row in enumerate(rows) if row.strip(" ")), None)
    if first is not None and heading_path and (rows[first] == heading_path or _one_spaced(rows[first]).lower() == _one_spaced(heading_path).lower()):
        del rows[first : first + (2 if first + 1 < len(rows) and not rows[first + 1].strip(" ") else 1)]
    if "|" not in text:
        return "\n".join(rows).strip(BLANKS) or text
    found, run = [], []

    def put_run():
        sizes = sorted(len(c) for cells in run for c in cells if c)
        counts = [len(cells) for cells in run]
        ends = sum(len(_PROSE.findall(c)) for cells in run for c in cells)
        middle = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) / 2
        most = max(counts)
        if len(run) < 2 or min(counts) < 2 or most - min(counts) > layout.MOST_WIDER or sizes[-1] > layout.CELL_LONGEST or middle > layout.CELL_MEDIAN or ends >= len(run):
            found.extend(" ".join(c for c in cells if c).strip(" ") for cells in run)
        else:
            bars = ["| " + " | ".join(cells + [""] * (most - len(cells))) + " |" for cells in run]
            found.extend([bars[0], "| " + " | ".join(["---"] * most) + " |", *bars[1:]])
        run.clear()

    for row in rows:
        plain = row.strip(" ")
        cells = [c.strip(" ") for c in plain[1:-1].split("|")] if len(plain) >= 2 and plain[0] == plain[-1] == "|" else []
        if any(cells):
            run.append(cells)
            continue
        if run:
            put_run()
        found.append(row)
    if run:
        put_run()
    return "\n".join(found).strip(BLANKS) or text
