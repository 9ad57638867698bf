"""Merkle manifests of a dataset, in DataFrame operations only.

Leaves are digests of rows; within a source they stand in the order of their ids, every three neighbours are hashed to
a node of the next level, until one node is left: the source's subroot. Subroots are the leaves of one more tree, whose
top is the root. A row's proof are the siblings on its way to the root.

Levels are climbed in bands of seven. A band deals its nodes by blocks of 3**7 neighbours, which no run of three crosses,
and sorts them once; each of its levels is a window over the block. Node j of level k is held by the row of its first
child, at place j * 3**k: the columns ``lag`` and ``lead`` at the fixed offsets 3**k and 2 * 3**k, masked by the slot in
the run and by the run's length, give its siblings there, that row hashes the parent if the slot is 0, and the rows
below a node take its siblings from its first row. The largest group of a window has 3**7 rows, however large the
source, and stays below the 4096 rows that Spark's windows hold in memory.

Places in a source come from a range partition by source and id (so a hot source lies in many partitions), the place
in the partition, and how many rows the partitions before hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.llm.common import small_side, stored

ARITY, BAND = 3, 7
WIDE = ARITY**BAND
#: Most rows of the table of partition counts that are broadcast.
COUNTS = 100_000
#: Most heads of blocks, with their paths, that are broadcast.
HEADS = 10_000


def hashed(*parts: Column) -> Column:
    """The SHA-256 of concatenated digests, each as lowercase hex text; digests are binary here."""
    return F.unhex(F.sha2(F.concat(*[F.lower(F.hex(p)) for p in parts]).cast("binary"), 256))


def leaf(*values: Column) -> Column:
    """The digest of a row: of each value ``-`` if null, else its length in bytes of UTF-8, ``:``, and the value."""
    texts = [v.cast("string") for v in values]
    coded = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*coded).cast("binary"), 256))


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos``, the place among those of the same ``key`` by ``order``, and ``n``, how many these are.

    The number of the input row comes last, so that rows that are alike can be parted, too.
    """
    by = ["key", *order, "_seq"]
    ranged = rows.withColumn("_seq", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_seq")
    at = stored(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = at.groupBy("key", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("key").orderBy("_part")
    counts = counts.withColumns({"_before": F.sum("_rows").over(before) - F.col("_rows"), "n": F.sum("_rows").over(W.partitionBy("key"))})
    counts = small_side(stored(counts.drop("_rows"), "partition-counts"), COUNTS)
    placed = at.withColumn("_part", part).join(counts, ["key", "_part"])
    return placed.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_first", "_before")


def _climbed(nodes: DataFrame) -> DataFrame:
    """A band of ``nodes`` (key, pos, n, digest, and others): adds ``block``, the node's ``path`` within the band (left and
    right siblings of each level that has more than one node), and ``head``, in first rows the node seven levels up."""
    block = W.partitionBy("key", "block").orderBy("pos")
    so_far = block.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = nodes.withColumns({"block": F.floor(F.col("pos") / WIDE).cast("long"), "head": F.col("digest"), "path": F.array().cast("array<struct<left:binary,right:binary>>")})
    width = F.col("n")
    empty = F.lit(b"")
    for k in range(BAND):
        step = ARITY**k
        first = F.col("pos") % step == 0
        node = F.floor(F.col("pos") / step)
        slot, run = node % ARITY, F.least(width - (node - node % ARITY), F.lit(ARITY))
        neighbours = {
            "l2": F.when(slot >= 2, F.lag("head", 2 * step).over(block)), "l1": F.when(slot >= 1, F.lag("head", step).over(block)),
            "r1": F.when(slot + 1 < run, F.lead("head", step).over(block)), "r2": F.when(slot + 2 < run, F.lead("head", 2 * step).over(block)),
        }
        rows = rows.withColumns({name: F.coalesce(F.when(first, c), empty) for name, c in neighbours.items()})
        siblings = F.struct(F.concat("l2", "l1").alias("left"), F.concat("r1", "r2").alias("right"))
        rows = rows.withColumn("own", F.when(first & (width > 1), siblings))
        up = F.when(width > 1, F.when(first & (slot == 0), hashed(F.col("head"), F.col("r1"), F.col("r2")))).otherwise(F.when(F.col("pos") == 0, F.col("head")))
        path = F.when(width > 1, F.concat("path", F.array(F.last("own", ignorenulls=True).over(so_far)))).otherwise(F.col("path"))
        rows = rows.withColumns({"path": path, "head": up}).drop("l2", "l1", "r1", "r2", "own")
        width = F.ceil(width / ARITY)
    return rows


def trees(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """Trees over ``rows`` (``key``, ``digest``, ``order``, and others), one for each key.

    Returns the rows with the ``path`` of each (array of left and right siblings, digests one after another, of each
    level with more than one node, from the leaves up), and ``(key, top)``.
    """
    nodes = _placed(rows, *order)
    bands = [stored(_climbed(nodes), "band")]
    while (bands[-1].agg(F.max("n")).first()[0] or 0) > WIDE:
        heads = bands[-1].where(F.col("head").isNotNull() & (F.col("pos") % WIDE == 0))
        up = heads.select("key", F.col("block").alias("pos"), F.ceil(F.col("n") / WIDE).alias("n"), F.col("head").alias("digest"))
        bands.append(stored(_climbed(up), "band"))
    tops = bands[-1].where("pos = 0").select("key", F.col("head").alias("top"))
    above = None
    for band in reversed(bands):
        own = band
        if above is not None:
            own = band.join(small_side(above, HEADS), ["key", "block"]).withColumn("path", F.concat("path", "_above")).drop("_above")
        own = own.drop("head", "n")
        above = own.select("key", F.col("pos").alias("block"), F.col("path").alias("_above"))
        found = own
    return found.drop("pos", "block"), tops


def folded(digest: Column, path: Column) -> Column:
    """The top that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda c, x: hashed(x["left"], c, x["right"]))


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """``(doc_id, leaf, subroot, root, path, changed)``: the Merkle tree of ``docs``, digests binary.

    A leaf is the digest of doc_id, source, lang, n_chars and text; other columns are ignored. ``changed`` is the digest
    with ``altered`` in place of the text, null where these are the same; :func:`folded` of it and ``path`` is the root
    only if nothing was changed. Nulls are marked in a leaf; null sources are a source, the first one, and null ids come
    first. Rows that share an id come by their leaf, and those that are alike in any order, each with a leaf of its own.
    An empty table has no rows.
    """
    values = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    text = F.col("text").cast("string")
    altered = text if altered is None else altered
    # Keys sort like sources do, with null before the empty one.
    key = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    same = altered.eqNullSafe(text)
    leaves = docs.select("doc_id", key.alias("key"), values(text).alias("digest"), F.when(~same, values(altered)).alias("changed"))
    rows, subroots = trees(stored(leaves, "leaves"), "doc_id", "digest")
    subroots = stored(subroots.select(F.lit("").alias("key"), F.col("key").alias("source_key"), F.col("top").alias("digest")), "subroots")
    above, root = trees(subroots, "source_key")
    above = above.select(F.col("source_key").alias("key"), F.col("digest").alias("subroot"), F.col("path").alias("_above"))
    above = small_side(stored(above.crossJoin(F.broadcast(root.select(F.col("top").alias("root")))), "tops"), HEADS)  # one root
    joined = rows.join(above, "key")
    return joined.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "_above").alias("path"), "changed")


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, as lowercase hex text."""
    joined = F.array_join(F.transform(path, lambda x: F.lower(F.hex(F.concat(x["left"], x["right"])))), "")
    return F.sha2(joined.cast("binary"), 256)
