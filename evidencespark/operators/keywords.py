"""Keyword indexes of help files: chains of leaf blocks, topics behind offsets, and groups of keywords by topic.

All tables carry the ``file`` they belong to. What is wrong with a file is a row of its own, and the file then has no
keywords; other files go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.sources.shared import stored

#: The pointer that ends a chain, the most topics of a keyword, its longest text, keywords of a group.
END, MOST_TOPICS, LONGEST, GROUP = 0xFFFFFFFF, 4096, 488, 32
#: The length of what stands before an address, and the offset that means no title.
ADDRESS_HEAD, NO_TITLE = 8, 0xFFFFFFFF


def _large(df: DataFrame) -> DataFrame:
    """``df`` joined by a shuffle: tables of numbers are so small as files that Spark would broadcast them, through the driver."""
    return df.hint("merge")


def walked(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(file, block, pos)`` of the blocks on each file's chain from block 0, and ``(file, error)`` of chains that are none.

    ``leaves`` are (file, block, next_block), a row for each block; ``next_block`` of the last is ``END``. Chains are
    followed by doubling: round k knows the 2**k-th block after each block, and so the next 2**k blocks of every
    chain, so a chain of n blocks takes log n joins. A chain that goes on for as many blocks as the file has runs in a
    loop; one that leads to a block that is not there is broken.
    """
    sizes = stored(leaves.groupBy("file").agg(F.count(F.lit(1)).alias("blocks")), "file-sizes")
    most = sizes.agg(F.max("blocks")).first()[0] or 0
    jumps = stored(leaves.where(F.col("next_block") != END).select("file", "block", F.col("next_block").alias("to")), "jumps")
    chain = stored(sizes.select("file", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("pos")), "chain")
    step = 1
    while step <= most:
        new = stored(chain.join(_large(jumps), ["file", "block"]).select("file", F.col("to").alias("block"), (F.col("pos") + step).alias("pos")), "chain")
        if new.isEmpty():
            break
        chain = stored(chain.unionByName(new), "chain")
        further = jumps.select("file", F.col("block").alias("to"), F.col("to").alias("_to"))
        jumps = stored(jumps.join(_large(further), ["file", "to"]).select("file", "block", F.col("_to").alias("to")), "jumps")
        step *= 2
    looped = chain.join(sizes, "file").where("pos >= blocks").select("file", F.lit("LOOP").alias("error"))
    lost = chain.join(_large(leaves.select("file", "block")), ["file", "block"], "left_anti").select("file", F.lit("BROKEN").alias("error"))
    errors = stored(looped.unionByName(lost).groupBy("file").agg(F.max("error").alias("error")), "chain-errors")
    return chain.join(errors, "file", "left_anti"), errors


def records(chain: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(file, ordinal, keyword, topics)`` of the entries along the chains, and ``(file, error)``.

    ``entries`` are (file, block, nth, keyword, see_also, topics): see_also is 0 for keywords with topics and 2 for those
    that refer to another one. Keywords are one-spaced; blank ones, very long ones and those without topics have no
    ordinal. Entries of other kinds, or with too many topics, spoil their file.
    """
    placed = stored(entries.join(_large(chain), ["file", "block"]), "entries")
    wrong = F.when(~F.col("see_also").isin(0, 2), "LINK_TYPE").when(F.size("topics") > MOST_TOPICS, "FAN_OUT")
    errors = stored(placed.withColumn("error", wrong).where("error IS NOT NULL").groupBy("file").agg(F.max("error").alias("error")), "entry-errors")
    text = F.trim(F.regexp_replace("keyword", r"\s+", " "))
    kept = placed.withColumn("keyword", text).where((F.col("keyword") != "") & (F.length("keyword") <= LONGEST) & (F.col("see_also") == 0) & (F.size("topics") > 0))
    kept = kept.join(errors, "file", "left_anti")
    counts = kept.groupBy("file", "pos").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("pos")) - F.col("n")  # a row for each block
    inside = F.row_number().over(W.partitionBy("file", "pos").orderBy("nth"))
    numbered = kept.withColumn("_inside", inside).join(_large(counts.select("file", "pos", before.alias("_before"))), ["file", "pos"])
    return numbered.select("file", (F.col("_before") + F.col("_inside")).cast("long").alias("ordinal"), "keyword", "topics"), errors


def topic_references(found: DataFrame, topics: DataFrame, url_table: DataFrame, url_strings: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(file, topic, title, url, path, anchor)`` of the topics that ``found`` keywords name, and ``(file, error)``.

    ``topics`` are (file, topic, title_offset, url_table_offset), ``url_table`` (file, offset, topic, url_offset), and
    ``url_strings`` and ``titles`` (file, offset, text): one join for each offset. A topic or an entry that is not there,
    and an entry of another topic, spoil the file. Topics whose path is absolute, climbs up or has a colon are left
    out; one without a title has the name of its path.
    """
    wanted = found.select("file", F.explode("topics").alias("topic")).distinct()
    rows = wanted.join(_large(topics), ["file", "topic"], "left")
    links = url_table.select("file", F.col("offset").alias("url_table_offset"), F.col("topic").alias("_mapped"), "url_offset")
    rows = rows.join(_large(links), ["file", "url_table_offset"], "left")
    addresses = url_strings.select("file", (F.col("offset") - ADDRESS_HEAD).alias("url_offset"), F.col("text").alias("_url"))
    rows = rows.join(_large(addresses), ["file", "url_offset"], "left")
    rows = rows.join(_large(titles.select("file", F.col("offset").alias("title_offset"), F.col("text").alias("_title"))), ["file", "title_offset"], "left")
    wrong = F.when(F.col("url_table_offset").isNull(), "NO_TOPIC").when(F.col("_mapped").isNull(), "NO_LINK").when(F.col("_mapped") != F.col("topic"), "OTHER_TOPIC").when(F.col("_url").isNull(), "NO_ADDRESS")
    rows = stored(rows.withColumn("error", wrong), "topic-links")
    errors = stored(rows.where("error IS NOT NULL").groupBy("file").agg(F.max("error").alias("error")), "topic-errors")
    url = F.trim(F.regexp_replace(F.replace("_url", F.lit("\\"), F.lit("/")), "^/+", ""))
    path = F.regexp_extract("url", "^[^#]*", 0)
    rows = rows.where("error IS NULL").join(errors, "file", "left_anti").withColumn("url", url).withColumn("path", path)
    rows = rows.where(F.col("path") != "").where(~F.startswith("path", F.lit("/")) & ~F.array_contains(F.split("path", "/"), "..") & ~F.contains("path", F.lit(":")))
    name = F.regexp_extract("path", "([^/]+)/*$", 1)
    stem = F.coalesce(F.nullif(F.regexp_extract(name, r"^(.+)\.[^.]+$", 1), F.lit("")), name)
    title = F.trim(F.regexp_replace(F.when(F.col("title_offset") != NO_TITLE, F.coalesce("_title", F.lit(""))).otherwise(""), r"\s+", " "))
    anchor = F.nullif(F.regexp_extract("url", "^[^#]*#(.*)$", 1), F.lit(""))
    return rows.select("file", "topic", F.coalesce(F.nullif(title, F.lit("")), stem).alias("title"), "url", "path", anchor.alias("anchor")), errors


def segments(found: DataFrame, references: DataFrame, group: int = GROUP) -> DataFrame:
    """``(file, topic, nth, text, symbol, keyword_start, keyword_end, n_keywords)``: the keywords of each topic in groups.

    A keyword counts once for a topic in any case, at its first ordinal. ``symbol`` is the last part of a group's first
    keyword.
    """
    each = found.select("file", "ordinal", "keyword", F.explode(F.array_distinct("topics")).alias("topic"))
    each = each.join(_large(references.select("file", "topic")), ["file", "topic"])
    first = each.groupBy("file", "topic", F.lower("keyword").alias("_folded")).agg(F.min(F.struct("ordinal", "keyword")).alias("k"))
    nth = F.floor((F.row_number().over(W.partitionBy("file", "topic").orderBy("k.ordinal")) - 1) / group).cast("long")
    rows = first.select("file", "topic", "k.ordinal", "k.keyword", nth.alias("nth"))
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "keyword")))  # ``group`` of them at most
    rows = rows.groupBy("file", "topic", "nth").agg(listed.alias("k"))
    words = F.transform("k", lambda x: x["keyword"])
    symbol = F.trim(F.element_at(F.split(words[0], ","), -1))
    return rows.select("file", "topic", "nth", F.array_join(words, "\n").alias("text"), symbol.alias("symbol"), F.col("k")[0]["ordinal"].alias("keyword_start"), F.element_at("k", -1)["ordinal"].alias("keyword_end"), F.size("k").cast("long").alias("n_keywords"))
