"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of ``block_bytes`` bytes. Level 0 sorts the distinct blocks and gives each an integer
name; level k names the distinct pairs of neighbouring names of level k - 1 in the same way, until a text has one
name. Two texts are equal exactly if they have the same number of blocks and the same last name: equal blocks or
pairs have one name, different ones never share it.

A block travels once, to the task that sorts it. Its name comes back by a 128-bit digest; digests that different
blocks share are found by a count, and those blocks are named and joined by their bytes instead.

Names come from the position in a hash partition after a sort, so there is no single-task sort; the tables of a
level are written to the shared folder, so a name is decided once. Hot blocks and identities are combined before
their shuffle, and joined from written tables, where adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidencespark.llm.common import free_name, lower_ascii, stored

#: Stands for "no right neighbour" in a pair; names are never -1.
_NONE = -1


def two_digests(block: Column) -> tuple[Column, Column]:
    return F.xxhash64(block), F.xxhash64(F.lit(1), block)


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """The distinct rows of ``df``, sorted in their partitions and named by partition and position."""
    return df.distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def text_identities(docs: DataFrame, block_bytes: int = 4096, digests: Callable = two_digests) -> DataFrame:
    """``(doc_id, digest, n_blocks, name, times)``, a row for each distinct pair of id and normalised text.

    ``(n_blocks, name)`` is the identity; ``digest`` is the SHA-256 of the normalised text (A-Z lower-cased, null
    as empty), which here only tells apart texts that share an id; ``times`` counts the rows of that id and text.
    """
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    whole = docs.select("doc_id", text.alias("norm"))
    whole = whole.select("doc_id", F.col("norm").cast("binary").alias("norm"))
    n = F.greatest(F.lit(1), F.ceil(F.length("norm") / block_bytes)).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("norm"), i * block_bytes + 1, F.lit(block_bytes))
    )
    blocks = whole.select(F.explode(cut).alias("block"))
    h1, h2 = digests(F.col("block"))
    names = stored(_numbered(blocks.select(h1.alias("h1"), h2.alias("h2"), "block"), "block").select("h1", "h2", "name"), "block-names")

    placed = whole.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), n.alias("n_blocks"), F.posexplode(cut).alias("pos", "block"))
    placed = placed.withColumns({"h1": h1, "h2": h2})
    clashing = stored(names.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "clashing-digests")
    at = ["doc_id", "digest", "n_blocks", "pos"]
    if clashing.isEmpty():
        named = placed.drop("block").join(names, ["h1", "h2"]).select(*at, "name")
    else:  # the same naming, by the bytes themselves
        apart = placed.join(clashing, ["h1", "h2"])
        own = stored(_numbered(apart.select("block"), "block").withColumn("name", -2 - F.col("name")), "block-names")
        clear = placed.drop("block").join(clashing, ["h1", "h2"], "left_anti").join(names, ["h1", "h2"])
        named = clear.select(*at, "name").unionByName(apart.join(own, "block").select(*at, "name"))

    level = stored(named.withColumns({"width": F.col("n_blocks"), "times": F.lit(1).cast("long")}), "level-0")
    widest = level.agg(F.max("width")).first()[0] or 1
    ended = level.where("width = 1")
    while widest > 1:
        even = F.col("pos") % 2 == 0
        pairs = (
            level.where("width > 1")
            .groupBy("doc_id", "digest", "n_blocks", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(_NONE)).alias("b"),
                F.ceil(F.max("width") / 2).cast("int").alias("width"),
                F.sum(F.when(even, F.col("times"))).alias("times"),
            )
        )
        pairs = stored(pairs, "pairs")
        names = stored(_numbered(pairs.select("a", "b"), "a", "b"), "pair-names")
        level = stored(pairs.join(names, ["a", "b"]).select("doc_id", "digest", "n_blocks", "pos", "name", "width", "times"), "level")
        ended = ended.unionByName(level.where("width = 1"))
        widest = (widest + 1) // 2
    return ended.groupBy("doc_id", "digest", "n_blocks", "name").agg(F.sum("times").alias("times"))


def exact_groups(docs: DataFrame, block_bytes: int = 4096, digests: Callable = two_digests) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, digest)``: groups of equal texts; the largest ``doc_id`` stays.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are ignored. Null texts are empty texts. There is
    a row for each row of ``docs``: rows that repeat an id and a text each count in ``group_size`` and are kept or not
    alike. A null id loses to any other; in a group of null ids only, ``keep_id`` is null and its rows are kept. An
    empty table gives an empty result.
    """
    groups = _decided(docs, block_bytes, digests)
    return groups.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("_", "times")


def _decided(docs: DataFrame, block_bytes: int, digests: Callable) -> DataFrame:
    """:func:`exact_groups` with one row for rows that repeat an id and a text, and how many these are (``times``)."""
    each = stored(text_identities(docs, block_bytes, digests), "identities")
    groups = each.groupBy("n_blocks", "name").agg(F.max("doc_id").alias("top"), F.sum("times").alias("size"), F.count(F.lit(1)).alias("ids"))
    groups = stored(groups.where("ids > 1").drop("ids"), "groups")
    joined = each.join(groups, ["n_blocks", "name"], "left")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", "times").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "digest",
        "times",
    )


def drop_exact_copies(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay, each once, with all their columns; see :func:`exact_groups`."""
    keep_id, keep_digest, row_id, row_digest = (free_name(docs, c) for c in ("keep_id", "keep_digest", "row_id", "row_digest"))
    decided = _decided(docs.select("doc_id", "text"), block_bytes, two_digests).where("kept")
    kept = decided.select(F.col("doc_id").alias(keep_id), F.col("digest").alias(keep_digest), "times")
    norm = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.withColumns({row_digest: F.unhex(F.sha2(norm.cast("binary"), 256)), row_id: F.col("doc_id")})
    same = F.col(row_digest).eqNullSafe(F.col(keep_digest)) & F.col(row_id).eqNullSafe(F.col(keep_id))
    kept = stored(kept, "kept")
    rows = keyed.join(kept.drop("times"), same)
    repeated = kept.where("times > 1")
    if not repeated.isEmpty():
        once = keyed.join(repeated.drop("times"), same).dropDuplicates([row_id, row_digest])
        rows = keyed.join(kept.where("times = 1").drop("times"), same).unionByName(once)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
