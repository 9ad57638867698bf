"""Pages of positioned words: lines, reading order, and blocks below their headings.

Positions are points from the top left of a page. Only the clustering of words into rows goes one by one, and that for
one page at a time; all else are windows by page, and by document for the headings that are open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from evidencespark.sources.shared import stored

#: How far a word may stand from a row's median top, in points and in sizes, and among how many last rows.
ROW_POINTS, ROW_SIZES, OPEN_ROWS = 2.0, 0.35, 4
#: A gap that parts columns, in points and in sizes; the share of a page that a line without column spans.
CELL_POINTS, CELL_SIZES, FULL_WIDTH = 18.0, 2.5, 0.65
#: A gap that parts blocks, in points and in body sizes.
BLOCK_POINTS, BLOCK_SIZES = 18.0, 1.8
#: Sizes of headings, in body sizes, by level; bold lines are of the last level.
HEADINGS = ((1.8, 1), (1.5, 2), (1.28, 3), (1.12, 4))
LONGEST_HEADING = 160
#: What is no heading, and what opens an item of a list.
LEADER, TRIVIAL, SENTENCE_END = r"[.…·]{4,}", r"(?i)^(?:[ivxlcdm]+|\d+|task\s+\d+)$", r"[。！？!?；;.]$"
LIST_ITEM = r"^(?:[-*•]|\d+[.)]|[（(]?[一二三四五六七八九十]+[）)])\s*"
#: Marks that take no blank before them, and the letters between which none is put.
TIGHT, CJK = r"^[,.:;)\]}，。：；]", "[㐀-鿿]"
PAGE = ["doc_id", "page"]


class PageRows:
    """The last rows of a page while its words come one by one, by (top, x0); the tops of a row so come in order."""

    def __init__(self):
        self.n, self.last = 0, []

    def put(self, top: float, size: float) -> int:
        """The row of the next word, from 1: the latest of the last rows whose median top is near enough, or a new one."""
        near = max(ROW_POINTS, size * ROW_SIZES)
        for back, tops in enumerate(reversed(self.last)):
            if abs((tops[(len(tops) - 1) // 2] + tops[len(tops) // 2]) / 2 - top) <= near:
                tops.append(top)
                return self.n - back
        self.last = [*self.last[1 - OPEN_ROWS :], [top]]
        self.n += 1
        return self.n


def rows_of(tops: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The row of each word of a page, from 1; words come by (top, x0)."""
    page = PageRows()
    return np.array([page.put(top, size) for top, size in zip(tops.tolist(), sizes.tolist(), strict=True)], np.int64)


def with_rows(words: DataFrame) -> DataFrame:
    """``words`` with their ``line``; a task holds the last rows of one page."""
    at = [words.columns.index(c) for c in (*PAGE, "top", "font_size")]
    schema = words.schema.add(StructField("line", LongType()))

    def run(batches):
        rows, own = PageRows(), None
        for batch in batches:
            found = []
            values = (batch.column(i).to_numpy(zero_copy_only=False).tolist() if i in at[2:] else batch.column(i).to_pylist() for i in at)
            for doc, page, top, size in zip(*values, strict=True):
                if (doc, page) != own:
                    rows, own = PageRows(), (doc, page)
                found.append(rows.put(top, size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "line"])

    ordered = words.repartition(*PAGE).sortWithinPartitions(*PAGE, "top", "x0", "nth")
    return ordered.mapInArrow(run, schema)


def lines(words: DataFrame) -> DataFrame:
    """``(doc_id, page, line, text, x0, top, x1, bottom, font_size, bold, columns)`` of ``words``.

    ``words`` have (doc_id, page, nth, text, x0, top, x1, bottom, font_size, bold); ``nth`` decides between words at one
    place. Words of a line stand by x0, with a tab where a gap parts columns, and a blank where a gap is no part of the
    writing. Lines without letters are left out.
    """
    by_place = W.partitionBy(*PAGE, "line").orderBy("x0", "nth")
    rows = with_rows(words)
    before = {c: F.lag(c).over(by_place) for c in ("text", "x1", "font_size")}
    rows = rows.withColumns({f"_{c}": v for c, v in before.items()})
    gap = F.col("x0") - F.col("_x1")
    wide = gap > F.greatest(F.lit(CELL_POINTS), F.greatest("_font_size", "font_size") * CELL_SIZES)
    tight = (gap <= 0) | F.col("_text").rlike("[ /-]$") | F.col("text").rlike(TIGHT) | (F.col("_text").rlike(f"{CJK}$") & F.col("text").rlike(f"^{CJK}"))
    mark = F.when(F.col("_text").isNull(), "").when(wide, "\t").when(tight, "").otherwise(" ")
    rows = rows.withColumns({"_mark": mark, "_part": F.concat(mark, "text")})
    parts = F.array_sort(F.collect_list(F.struct("x0", "nth", "_part")))
    found = rows.groupBy(*PAGE, "line").agg(
        F.trim(F.array_join(F.transform(parts, lambda p: p["_part"]), ""), F.lit(" \t\n\r\f\x0b")).alias("text"),
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
        F.median("font_size").alias("font_size"), F.bool_or("bold").alias("bold"), (F.count_if(F.col("_mark") == "\t") + 1).alias("columns"),
    )
    return found.where("text <> ''")


def in_reading_order(lines: DataFrame, width: float) -> DataFrame:
    """``lines`` with their ``position`` on the page, from 1.

    Lines over the middle or of almost full width are barriers. Between two of them the left column is read before the
    right one if both have two lines or more; else, and on pages of fewer than four lines, lines are read from the top.
    """
    page, middle = W.partitionBy(*PAGE), width / 2
    falling = page.orderBy("top", "x0", "line")
    barrier = ((F.col("x0") < middle) & (F.col("x1") > middle)) | (F.col("x1") - F.col("x0") >= width * FULL_WIDTH)
    rows = lines.withColumn("_barrier", barrier & (F.count(F.lit(1)).over(page) >= 4))
    rows = rows.withColumn("_section", F.sum(F.col("_barrier").cast("int")).over(falling))
    section = W.partitionBy(*PAGE, "_section")
    left = (F.col("x0") + F.col("x1")) / 2 < middle
    split = (F.count_if(~F.col("_barrier") & left).over(section) >= 2) & (F.count_if(~F.col("_barrier") & ~left).over(section) >= 2) & (F.count(F.lit(1)).over(page) >= 4)
    rows = rows.withColumn("_column", F.when(F.col("_barrier"), -1).when(split & ~left, 1).otherwise(0))
    position = F.row_number().over(page.orderBy("_section", "_column", "top", "x0", "line")).cast("long")
    return rows.withColumn("position", position).drop("_barrier", "_section", "_column")


def heading_level(text: Column, size: Column, bold: Column, columns: Column, body: Column) -> Column:
    """The level of a heading, 1 to 4; null for a line that is none."""
    plain = F.trim(text)
    none = (F.length(plain) > LONGEST_HEADING) | (columns > 1) | plain.rlike(LEADER) | plain.rlike(TRIVIAL) | plain.rlike(SENTENCE_END)
    ratio = size / F.greatest(body, F.lit(1.0))
    level = F.when(none, None)
    for least, n in HEADINGS:
        level = level.when(ratio >= least, n)
    return level.when(bold, HEADINGS[-1][1])


def blocks(lines: DataFrame, width: float) -> DataFrame:
    """``(doc_id, page, block, layout_type, heading_path, text, bbox, start_line, end_line)`` of lines in reading order.

    A heading closes those of its level and below, over the pages of a document. Other lines are tables (runs of two
    lines or more with columns), items of lists, or paragraphs; a block ends at a heading, at another type, at a
    large gap, and with the page. A block's text has the path of its headings before it, unless it begins with it. A
    page of headings only gives one block of type ``heading`` with the last of them, at the top left.
    """
    page, by_place = W.partitionBy(*PAGE), W.partitionBy(*PAGE).orderBy("position")
    whole = W.partitionBy("doc_id").orderBy("page", "position").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = lines.withColumn("_body", F.median("font_size").over(page))
    rows = rows.withColumn("_level", heading_level(F.col("text"), F.col("font_size"), F.col("bold"), F.col("columns"), F.col("_body")))
    titles = []
    for _, n in HEADINGS:  # the last heading of a level or above, if it is of that level
        last = F.last(F.when(F.col("_level") <= n, F.struct("_level", "text")), ignorenulls=True).over(whole)
        titles.append(F.when(last["_level"] == n, last["text"]))
    rows = rows.withColumn("_titles", F.filter(F.array(*titles), lambda t: t.isNotNull()))
    tabular = F.col("columns") >= 2
    rows = rows.withColumn("_run", F.sum((~tabular).cast("int")).over(by_place))
    runs = F.count_if(tabular).over(W.partitionBy(*PAGE, "_run"))
    kind = F.when(tabular & (runs >= 2), "table").when(F.col("text").rlike(LIST_ITEM), "list").otherwise("paragraph")
    rows = rows.withColumn("_kind", F.when(F.col("_level").isNull(), kind))
    gap = F.col("top") - F.lag("bottom").over(by_place)
    opens = F.lag("_kind").over(by_place).isNull() | (F.lag("_kind").over(by_place) != F.col("_kind")) | (gap > F.greatest(F.lit(BLOCK_POINTS), F.col("_body") * BLOCK_SIZES))
    rows = rows.withColumn("_opens", F.coalesce(opens, F.lit(True)) & F.col("_kind").isNotNull())
    rows = rows.withColumns({"_block": F.sum(F.col("_opens").cast("int")).over(by_place), "_filled": F.count("_kind").over(page)})
    rows = stored(rows, "lines-in-blocks")  # read twice below
    cells = F.concat(F.lit("| "), F.array_join(F.transform(F.split("text", "\t"), lambda c: F.trim(c)), " | "), F.lit(" |"))
    shown = F.when(F.col("_kind") == "table", cells).otherwise(F.col("text"))
    path = F.array_join("_titles", " > ")
    listed = F.array_sort(F.collect_list(F.struct("position", shown.alias("shown"))))
    number = lambda c: F.format_string("%.2f", c.cast("double"))
    box = lambda *cs: F.concat(F.lit("["), F.concat_ws(",", *map(number, cs)), F.lit("]"))
    found = rows.where(F.col("_kind").isNotNull()).withColumn("_path", path).groupBy(*PAGE, "_block").agg(
        F.first("_kind").alias("layout_type"), F.first("_path").alias("heading_path"), F.array_join(F.transform(listed, lambda r: r["shown"]), "\n").alias("text"),
        box(F.min("x0"), F.min("top"), F.max("x1"), F.max("bottom")).alias("bbox"), F.min("position").alias("start_line"), F.max("position").alias("end_line"),
    )
    last = F.max_by("_titles", "position")
    bare = rows.where("_filled = 0").groupBy(*PAGE).agg(last.alias("_titles"), F.first("_body").alias("_body"))
    one, zero = F.lit(1).cast("long"), F.lit(0.0)
    bare = bare.select(*PAGE, F.lit(1).cast("long").alias("_block"), F.lit("heading").alias("layout_type"), path.alias("heading_path"), F.element_at("_titles", -1).alias("text"), box(zero, zero, F.lit(width), F.col("_body")).alias("bbox"), one.alias("start_line"), one.alias("end_line"))
    every = found.unionByName(bare).withColumnRenamed("_block", "block")
    begins = (F.col("heading_path") == "") | F.startswith(F.col("text"), F.col("heading_path"))
    return every.withColumn("text", F.when(begins, F.col("text")).otherwise(F.concat("heading_path", F.lit("\n\n"), "text")))


#: The margins of a page, how large a line at the top may be, on how many pages a line repeats.
MARGIN, MARGIN_SIZE, LEAST_PAGES, PAGE_SHARE = 0.12, 1.2, 3, 0.6
LONGEST_MARGIN = 160
#: Where a printed page number stands, and what it looks like.
NUMBER_FROM = 0.82
NUMBER = r"(?i)^(?:(?:page|第)\s*)?([0-9]{1,6}|[ivxlcdm]{1,12})(?:\s*页)?$"


def _one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def printed_numbers(lines: DataFrame, height: float) -> DataFrame:
    """``(doc_id, page, position, number)``: the lowest line at the foot of a page that is nothing but a page number."""
    rows = lines.withColumn("number", F.regexp_extract(_one_spaced(F.col("text")), NUMBER, 1)).where((F.col("top") >= height * NUMBER_FROM) & (F.col("number") != ""))
    lowest = F.row_number().over(W.partitionBy(*PAGE).orderBy(F.desc("top"), "position"))
    return rows.withColumn("_nth", lowest).where("_nth = 1").select(*PAGE, "position", "number")


def margin_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(_one_spaced(text)), r"\d+", "#")


def margin_keys(lines: DataFrame, height: float, ratio: float = MARGIN) -> DataFrame:
    """``lines`` with their ``margin_key``: the folded text, digits as #, of one of the two lines at the top or foot of a page.

    Empty for lines elsewhere, for long ones, and for those at the top that are larger than the body.
    """
    page = W.partitionBy(*PAGE)
    at_top = (F.col("top") <= height * ratio) & (F.col("position") <= 2)
    at_foot = (F.col("bottom") >= height * (1 - ratio)) & (F.col("position") >= F.count(F.lit(1)).over(page) - 1)
    large = at_top & (F.col("font_size") > F.median("font_size").over(page) * MARGIN_SIZE)
    key = margin_key(F.col("text"))
    return lines.withColumn("margin_key", F.when((at_top | at_foot) & ~large & (F.length(key) <= LONGEST_MARGIN), key).otherwise(""))


def repeated_keys(keyed: DataFrame) -> DataFrame:
    """``(doc_id, margin_key, on_pages)`` of the keys that stand on three pages and 60 % of the pages of their document."""
    keyed = stored(keyed.select("doc_id", "page", "margin_key").distinct(), "margin-keys")  # read twice below
    pages = keyed.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    counts = keyed.where("margin_key <> ''").groupBy("doc_id", "margin_key").agg(F.count_distinct("page").alias("on_pages"))
    least = F.greatest(F.lit(LEAST_PAGES), F.ceil(F.col("pages") * PAGE_SHARE))
    return counts.join(pages, "doc_id").where(F.col("on_pages") >= least).drop("pages")


def visible(lines: DataFrame, height: float) -> DataFrame:
    """``lines`` without printed page numbers and without what repeats in the margins."""
    keyed = margin_keys(lines, height)
    kept = keyed.join(repeated_keys(keyed).select("doc_id", "margin_key"), ["doc_id", "margin_key"], "left_anti")
    kept = kept.join(printed_numbers(lines, height).select(*PAGE, "position"), [*PAGE, "position"], "left_anti")
    return kept.select(*lines.columns)


#: What a table of rows with bars may look like.
CELL_LONGEST, CELL_MEDIAN, MOST_WIDER = 80, 32, 1
PROSE = "[。；]"


def displayed(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``shown``, their text as it is shown: without the heading's line, and rows with bars as Markdown.

    A first line that repeats the heading goes, with a blank line after it. Rows between bars that follow each other are a
    table if there are two or more, with two cells or more and about as many in each, of which none is long, and with
    few ends of sentences; else they are running text. Where nothing is left the text stays as it is.
    """
    key = ["doc_id", "page", "block"]
    own, by_line = W.partitionBy(*key), W.partitionBy(*key).orderBy("pos")
    rows = blocks.select(*key, "heading_path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    blank = F.trim("line") == ""
    first = F.min(F.when(~blank, F.col("pos"))).over(own)
    folded = lambda c: F.lower(_one_spaced(c))
    rows = rows.withColumn("_heading", F.coalesce((F.col("pos") == first) & (F.col("heading_path") != "") & (folded(F.col("line")) == folded(F.col("heading_path"))), F.lit(False)))
    rows = rows.withColumn("_after", F.coalesce(F.lag("_heading").over(by_line), F.lit(False))).where(~F.col("_heading") & ~(F.col("_after") & blank))
    plain = F.trim("line")
    cells = F.transform(F.split(F.substring(plain, F.lit(2), F.length(plain) - 2), r"\|"), lambda c: F.trim(c))
    barred = (F.length(plain) >= 2) & F.startswith(plain, F.lit("|")) & F.endswith(plain, F.lit("|"))
    rows = rows.withColumn("cells", F.when(barred, cells)).withColumn("cells", F.when(F.exists("cells", lambda c: c != ""), F.col("cells")))
    rows = rows.withColumn("_run", F.sum(F.col("cells").isNull().cast("int")).over(by_line))
    filled = F.filter("cells", lambda c: c != "")
    runs = rows.where(F.col("cells").isNotNull()).groupBy(*key, "_run").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size("cells")).alias("least"), F.max(F.size("cells")).alias("most"), F.min("pos").alias("begin"),
        F.flatten(F.collect_list(F.transform(filled, lambda c: F.length(c)))).alias("sizes"), F.sum(F.length(F.regexp_replace(F.array_join(filled, ""), f"[^{PROSE[1:-1]}]", ""))).alias("ends"),
    )
    sizes = F.sort_array("sizes")
    at = lambda i: F.get(sizes, i.cast("int"))
    middle = (at(F.floor((F.size(sizes) - 1) / 2)) + at(F.floor(F.size(sizes) / 2))) / 2
    table = (F.col("n") >= 2) & (F.col("least") >= 2) & (F.col("most") - F.col("least") <= MOST_WIDER) & (F.array_max("sizes") <= CELL_LONGEST) & (middle <= CELL_MEDIAN) & (F.col("ends") < F.col("n"))
    runs = runs.select(*key, "_run", "most", "begin", table.alias("table"))
    rows = rows.join(runs, [*key, "_run"], "left")
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("most") - F.size("cells")))
    row = F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("most")), " | "), F.lit(" |"))
    running = F.trim(F.array_join(filled, " "))
    shown = F.when(F.col("cells").isNull(), F.col("line")).when(~F.col("table"), running).when(F.col("pos") == F.col("begin"), F.concat(row, F.lit("\n"), rule)).otherwise(row)
    listed = F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown"))))
    whole = rows.groupBy(*key).agg(F.array_join(F.transform(listed, lambda r: r["shown"]), "\n").alias("shown"))
    stripped = F.regexp_replace("shown", r"^\s+|\s+$", "")
    return blocks.join(whole.withColumn("shown", stripped), key, "left").withColumn("shown", F.coalesce(F.nullif("shown", F.lit("")), F.col("text")))
