"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Targets. Source sizes are summed; targets share ``total_ratio`` times all words by weight, none above
   ``max_repeats`` times its source, the excess reshared: the level at which this fills up has a closed form.
2. Quotas. The documents of a source fall by a hash of their id into ``blocks`` blocks, put in the order of a
   second hash. Whole passes over the source come first; what is left of the target is filled with blocks in that
   order, passing over those that are larger than what is left, in ``ROUNDS`` rounds. The next blocks are drawn in
   part: their cells (a second hash level) are filled in the same way, and of the next cells the one document is
   drawn that comes nearest to what is left.
3. Splitting tree. The drawn blocks of all passes are a vector of quotas by source. Each node of the tree gives
   half of its blocks to either child: its blocks get random keys, the lower half goes left. Counting these by
   source is an exact draw from the multivariate hypergeometric distribution. The leaves are the output shards.
4. Draws. A shard's quota of a source is the next run of that source's permuted blocks, so shards are disjoint
   within a pass; how often a document is taken is how often the shards draw its block, and rows are shuffled within
   their shard by a hash of document and pass.

The tree works on at most ``blocks * max_repeats`` rows for each source, whatever the number of documents, and
every random key is a hash of names and the seed, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.llm.common import WORD, free_name, small_side, stored

#: Most rows of a plan table that is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: So many blocks, then cells, that are not drawn whole are looked into for the rest of a quota.
EDGE = 32
#: Rounds in which blocks, then cells, are filled in; each passes over what is larger than the rest that it begins with.
ROUNDS = 3


@dataclass(frozen=True)
class MixPlan:
    """``sources``: one row for each source; ``blocks``: one for each source and block; ``cells``: for each cell of
    the blocks that may be drawn in part; ``edge``: the one document of each source drawn beyond whole cells;
    ``draws``: the shard of each block and pass that is drawn."""

    sources: DataFrame
    blocks: DataFrame
    cells: DataFrame
    edge: DataFrame
    draws: DataFrame


def _level(doc_id: Column, part: int, n: int) -> Column:
    """The document's place, of ``n``, on one level of the hash tree: hex digits of an MD5, as SQL has it too."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1 + 7 * part, 7), 16, 10).cast("long") % n).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], total_ratio: float, max_repeats: float) -> DataFrame:
    """``(source, source_size, weight, target)`` from ``(source, source_size)``; sources by code point, null last."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(max_repeats)))
    # Sources fill up in the order of most / weight. If the first k are full, the others share what these leave;
    # that share grows with k while the next source would still overflow, then falls: its maximum is the level.
    filling = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns(
        {
            "full": F.coalesce(F.sum("most").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "total": F.sum("source_size").over(W.partitionBy()) * F.lit(float(total_ratio)),
        }
    )
    share = (F.col("total") - F.col("full")) / F.col("open")
    t = t.withColumn("level", F.max(share).over(W.partitionBy()))
    target = F.least(F.col("most"), F.col("level") * F.col("weight"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_ratio: float = 1.5, max_repeats: int = 2, blocks: int = 1024, shards: int = 8, seed: int = 0) -> MixPlan:
    """The plan for ``docs(doc_id, text, source)``; ``shards`` is a power of two."""
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sized = sized.withColumns({"block": _level(F.col("doc_id"), 0, blocks), "cell": _level(F.col("doc_id"), 1, blocks)})
    sized = stored(sized, "mix-sizes")
    block_sums = stored(sized.groupBy("source", "block").agg(F.sum("size").alias("size")), "mix-blocks")
    sources = source_targets(block_sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_ratio, max_repeats)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(max_repeats)
    sources = sources.withColumn("passes", F.least(passes.cast("int"), F.lit(max_repeats)))
    rest = F.when(F.col("passes") < max_repeats, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(-1.0)
    sources = stored(sources.withColumn("rest", rest), "mix-sources")

    def on_source(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        """Join on source (null with null) and other columns, of which the left ones stay."""
        right = small_side(right.withColumnsRenamed({c: f"_{c}" for c in ("source", *more)}), BROADCAST_ROWS)
        same = F.col("source").eqNullSafe(F.col("_source"))
        for c in more:
            same = same & (F.col(c) == F.col(f"_{c}"))
        return left.join(right, same).drop("_source", *[f"_{c}" for c in more])

    ranked = on_source(block_sums, sources.select("source", "passes", "rest"))
    ranked = stored(_fill(ranked, [_order("block", seed, "block"), "block"]), "mix-ranked")
    part = ranked.where("state = 'part'").select("source", "block", "rank", "rest")
    inner = stored(on_source(sized, part, "block"), "mix-inner")
    cells = inner.groupBy("source", "block", "cell").agg(F.sum("size").alias("size"), F.max("rank").alias("above"), F.max("rest").alias("rest"))
    cells = stored(_fill(cells, ["above", _order("cell", seed, "cell"), "cell"]), "mix-cells")
    part = cells.where("state = 'part'").select("source", "block", "cell", F.col("rest").alias("left"))
    last = on_source(inner, part, "block", "cell").where((F.col("size") > 0) & (F.col("size") < 2 * F.col("left")))
    nearest = F.struct(F.abs(F.col("left") - F.col("size")), _order("doc", seed, "doc_id"), "doc_id")
    edge = last.groupBy("source").agg(F.min_by("doc_id", nearest).alias("doc_id"))
    return MixPlan(sources, ranked, cells, stored(edge, "mix-edge"), stored(_split(ranked, shards, seed), "mix-draws"))


def _order(what: str, seed: int, column: str) -> Column:
    """A random order that SQL has too."""
    return F.md5(F.concat_ws(":", F.lit(what), F.lit(str(seed)), F.col(column).cast("string")).cast("binary"))


def _fill(level: DataFrame, order: list) -> DataFrame:
    """Fill each source's ``rest`` with its rows: those get the state ``whole``.

    A round goes through the rows that are no larger than what is left, in the given order, as long as they fit
    together. The first ``EDGE`` rows that are in no round get the state ``part``, with what is left as their ``rest``.
    """
    own = W.partitionBy("source")
    level = level.withColumns({"rank": F.row_number().over(own.orderBy(*order)), "whole": F.lit(False)})
    for _ in range(ROUNDS):
        open_ = ~F.col("whole") & (F.col("size") <= F.col("rest"))
        upto = F.sum(F.when(open_, F.col("size")).otherwise(0)).over(own.orderBy("rank"))
        level = level.withColumn("fits", open_ & (upto <= F.col("rest")))
        filled = F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(own)
        level = level.withColumns({"whole": F.col("whole") | F.col("fits"), "rest": F.col("rest") - filled})
    nth = F.count_if(~F.col("whole")).over(own.orderBy("rank"))
    state = F.when(F.col("whole"), "whole").when((nth <= EDGE) & (F.col("rest") > 0), "part").otherwise("none")
    return level.withColumn("state", state).drop("whole", "fits")


def _split(ranked: DataFrame, shards: int, seed: int) -> DataFrame:
    """``(source, block, pass, shard)``: the splitting tree over quotas, then runs of permuted blocks for the leaves."""
    copies = F.col("passes") + F.when(F.col("state") == "none", 0).otherwise(1)
    drawn = ranked.withColumn("copies", copies).where("copies > 0")
    drawn = drawn.select("source", "block", "rank", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass"))
    quotas = drawn.groupBy("source", "pass").agg(F.count(F.lit(1)).cast("int").alias("quota")).withColumn("node", F.lit(0))
    width = shards
    while width > 1:
        each = quotas.select("source", "pass", "node", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("unit"))
        key = F.xxhash64(F.lit(seed), F.lit(width), "node", F.coalesce("source", F.lit("")), F.col("source").isNull(), "pass", "unit")
        each = stored(each.withColumn("key", key).withColumn("slot", F.shiftrightunsigned("key", 52)), "mix-units")
        # The lower half of a node's keys goes left: whole slots of keys by their counts, and of the slot in which the
        # half ends the keys that come first. So no task orders a whole node.
        slots = each.groupBy("node", "slot").agg(F.count(F.lit(1)).alias("n"))
        node = W.partitionBy("node")
        before = F.sum("n").over(node.orderBy("slot")) - F.col("n")
        room = F.floor(F.sum("n").over(node) / 2).cast("int") - before
        slots = slots.select(F.col("node").alias("_node"), F.col("slot").alias("_slot"), room.alias("room"))
        each = each.join(slots, (F.col("node") == F.col("_node")) & (F.col("slot") == F.col("_slot")))
        nth = F.row_number().over(W.partitionBy("node", "slot").orderBy("key", "source", "pass", "unit"))
        side = F.when(nth <= F.col("room"), 0).otherwise(1)
        each = each.withColumn("side", side)
        quotas = each.groupBy("source", "pass", (F.col("node") * 2 + F.col("side")).alias("node")).agg(F.count(F.lit(1)).cast("int").alias("quota"))
        width //= 2
    upto = F.sum("quota").over(W.partitionBy("source", "pass").orderBy("node"))
    runs = quotas.select(F.col("source").alias("_source"), F.col("pass").alias("_pass"), F.col("node").alias("shard"), (upto - F.col("quota")).alias("after"), upto.alias("upto"))
    # The permuted blocks of a pass, from its own random start on.
    own = W.partitionBy("source", "pass")
    turn = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), "pass"), F.count(F.lit(1)).over(own))
    place = F.pmod(F.row_number().over(own.orderBy("rank")) + turn, F.count(F.lit(1)).over(own)) + 1
    drawn = drawn.withColumn("place", place)
    hit = F.col("source").eqNullSafe(F.col("_source")) & (F.col("pass") == F.col("_pass")) & (F.col("place") > F.col("after")) & (F.col("place") <= F.col("upto"))
    return drawn.join(runs, hit).select("source", "block", "pass", "shard")


def word_count(text: Column) -> Column:
    """The number of words (what lies between ASCII white space); null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def copies_of(docs: DataFrame, plan: MixPlan, blocks: int = 1024) -> DataFrame:
    """``(row, source, block, source_size, target, passes)``: each row of ``docs`` as a struct, and the passes that take it.

    Passes are those in which some shard draws the row's block; from a block that is drawn in part, the last of them
    takes only its whole cells and the one document at the edge. The plan's tables are joined by source and block,
    by cell, and by document; each is broadcast only if it has at most ``BROADCAST_ROWS`` rows, and else joined on
    keys that spread a hot source over its blocks.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col("doc_id"), F.col("source").cast("string").alias("source"), _level(F.col("doc_id"), 0, blocks).alias("block"), _level(F.col("doc_id"), 1, blocks).alias("cell"))

    def renamed(df, **names):
        return df.select(*[F.col(a).alias(b) for a, b in names.items()])

    drawn = plan.draws.groupBy("source", "block").agg(F.sort_array(F.collect_list("pass")).alias("passes"))
    drawn = renamed(drawn, source="d_source", block="d_block", passes="d_passes")
    b = plan.blocks.join(renamed(plan.sources, source="s", source_size="source_size", target="target"), F.col("source").eqNullSafe(F.col("s")))
    b = b.join(drawn, F.col("source").eqNullSafe(F.col("d_source")) & (F.col("block") == F.col("d_block")), "left")
    b = renamed(b, source="b_source", block="b_block", d_passes="b_passes", state="b_state", source_size="source_size", target="target")
    d = d.join(small_side(b, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")), "left")
    c = renamed(plan.cells, source="c_source", block="c_block", cell="c_cell", state="c_state")
    d = d.join(small_side(c, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("c_source")) & (F.col("block") == F.col("c_block")) & (F.col("cell") == F.col("c_cell")), "left")
    e = renamed(plan.edge, source="e_source", doc_id="e_doc_id").withColumn("e_hit", F.lit(True))
    same = F.col("source").eqNullSafe(F.col("e_source")) & F.col("doc_id").eqNullSafe(F.col("e_doc_id"))
    d = d.join(small_side(e, BROADCAST_ROWS), same, "left")
    inside = (F.col("c_state") == "whole") | ((F.col("c_state") == "part") & F.col("e_hit"))
    passes = F.coalesce("b_passes", F.array().cast("array<int>"))
    left_out = (F.col("b_state") == "part") & ~F.coalesce(inside, F.lit(False))
    passes = F.when(left_out, F.slice(passes, F.lit(1), F.greatest(F.size(passes) - 1, F.lit(0)))).otherwise(passes)
    return d.select("row", "source", "block", "source_size", "target", passes.alias("passes"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_ratio: float = 1.5, max_repeats: int = 2, blocks: int = 1024, shards: int = 8, seed: int = 0) -> DataFrame:
    """The mix: the rows of ``docs``, each as often as it is drawn, with ``_pass``, ``_shard`` and ``_key``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; other columns stay, and of clashing names the new ones get
    further underscores. A document's size is its number of words (null text: 0). Sources weigh ``weights`` by turns
    in code-point order, null as the last source. Rows are in shuffled order within a shard: sorted by ``_key`` in
    partitions that hold parts of one shard each. Documents without words are drawn with their block. Rows that
    repeat an id fall into one place and are drawn alike. An empty table gives an empty mix.
    """
    names = [free_name(docs, c) for c in ("_pass", "_shard", "_key")]
    plan = plan_mix(docs, weights, total_ratio, max_repeats, blocks, shards, seed)
    drawn = copies_of(docs, plan, blocks).where(F.size("passes") > 0)
    drawn = drawn.select("row", "source", "block", F.explode("passes").alias("pass"))
    s = plan.draws.select(F.col("source").alias("s_source"), F.col("block").alias("s_block"), F.col("pass").alias("s_pass"), "shard")
    drawn = drawn.join(small_side(s, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") == F.col("s_block")) & (F.col("pass") == F.col("s_pass")))
    drawn = drawn.withColumn("key", F.xxhash64(F.lit(seed), "row.doc_id", "pass"))
    drawn = drawn.repartition("shard", F.pmod(F.col("key"), F.lit(64))).sortWithinPartitions("shard", "key")
    return drawn.select("row.*", *[F.col(a).alias(b) for a, b in zip(("pass", "shard", "key"), names, strict=True)])


def mix_summary(docs: DataFrame, **settings) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, a row for each row of ``docs``: the words the mix takes of it.

    A null source is a source of its own, the last one; null and empty texts have size 0 and nothing is taken of them.
    Rows that share an id lie in one cell and are drawn alike, a null id is hashed as an empty text, and ties in the order of
    blocks and cells go by their numbers. Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    plan = plan_mix(docs, **settings)
    sized = copies_of(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), plan, settings.get("blocks", 1024))
    return sized.select(
        "row.doc_id",
        "row.size",
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        (F.size("passes") * F.col("row.size")).cast("long").alias("taken"),
    )
