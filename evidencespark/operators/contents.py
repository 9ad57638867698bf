"""Tables of contents: the order of a site's topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.functions.places import topic_path

#: The target of an entry of a table of contents.
TARGET = r'(?is)<param\s[^>]*?name\s*=\s*"local"[^>]*?value\s*=\s*"([^"]*)"'


def in_order(topics: DataFrame, tocs: DataFrame) -> DataFrame:
    """``topics`` (site, path, ...) with ``position`` in their site: listed ones first, then the others by path.

    ``tocs`` are (site, toc_path, content). Files count by their paths, a topic counts where it is first listed, and
    case does not matter; targets are relative to the folder of their file. What no topic answers to is passed over.
    """
    targets = tocs.select("site", F.lower("toc_path").alias("toc"), F.regexp_extract("toc_path", r"^((?:.*/)?)[^/]*$", 1).alias("folder"), F.posexplode(F.regexp_extract_all("content", F.lit(TARGET), F.lit(1))).alias("nth", "target"))
    full = F.when(F.startswith(F.col("target"), F.lit("/")), F.col("target")).otherwise(F.concat("folder", "target"))
    listed = targets.select("site", F.lower(topic_path(full)).alias("key"), F.struct("toc", "nth").alias("rank")).where("key IS NOT NULL")
    listed = listed.groupBy("site", "key").agg(F.min("rank").alias("rank"))
    found = topics.withColumn("key", F.lower("path")).join(listed, ["site", "key"], "left")
    order = W.partitionBy("site").orderBy(F.col("rank").isNull(), "rank", "key", *[c for c in topics.columns if c not in ("site", "path")])
    return found.withColumn("position", F.row_number().over(order).cast("long")).select(*topics.columns, "position")
