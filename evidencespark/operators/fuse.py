"""Fusion, reordering, diversity, expansion and the context budget, all keyed by query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The rank constant of reciprocal rank fusion, and the over-fetch of a route.
RRF_K = 60
#: Most anchors that are broadcast to the chunks.
ANCHORS = 200_000


def over_fetch(top_k: int) -> int:
    return min(max(4 * top_k, 20), 100)


def rrf(routes: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """``(query_id, record_id, fusion_score, rank)`` of ranked routes; a record counts once in a route, at its best rank.

    A union and one aggregation take the place of a full outer join.
    """
    parts = None
    for i, (route, weight) in enumerate(routes):
        part = route.select("query_id", "record_id", "rank", F.lit(i).alias("route"), F.lit(weight).alias("weight"))
        parts = part if parts is None else parts.unionByName(part)
    best = parts.groupBy("query_id", "record_id", "route").agg(F.min("rank").alias("rank"), F.first("weight").alias("weight"))
    fused = best.groupBy("query_id", "record_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("fusion_score"))
    order = W.partitionBy("query_id").orderBy(F.desc("fusion_score"), "record_id")
    return fused.withColumn("rank", F.row_number().over(order).cast("long"))


def merge_routes(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Rankings of the subqueries of one route: summed reciprocal ranks, the best rank, and the largest raw score."""
    best = hits.groupBy("query_id", "subquery", "record_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score"))
    merged = best.groupBy("query_id", "record_id").agg(
        F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("rank_score"), F.min("rank").cast("long").alias("best_rank"), F.max("score").alias("score")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("rank_score"), "best_rank", "record_id")
    return merged.withColumn("rank", F.row_number().over(order).cast("long"))


def rerank(candidates: DataFrame, top_n: int) -> DataFrame:
    """Order by rerank score (where there is none: after all others, by fusion score), cut to ``top_n``."""
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), F.desc("fusion_score"), "record_id")
    return candidates.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_n)


def occurrences(text: Column, needle: Column) -> Column:
    """How often ``needle`` occurs in ``text`` without overlap."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("long")


def by_identifier(candidates: DataFrame) -> DataFrame:
    """Candidates whose text repeats identifiers of the query (five letters or more, with an underscore) come first."""
    ids = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z][a-z0-9_]{4,}"), F.lit(0)))
    ids = F.filter(ids, lambda x: F.instr(x, "_") > 0)
    total = F.aggregate(ids, F.lit(0).cast("long"), lambda s, x: s + occurrences(F.lower("text"), x))
    order = W.partitionBy("query_id").orderBy(F.desc("occurrences"), F.desc("fusion_score"), "record_id")
    return candidates.withColumn("occurrences", total).withColumn("rank", F.row_number().over(order).cast("long"))


def diversified(candidates: DataFrame) -> DataFrame:
    """First candidate of each content; of these the first of each topic, then the other ones, in rank order."""
    first = F.row_number().over(W.partitionBy("query_id", "content_sha256").orderBy("rank"))
    kept = candidates.withColumn("nth", first).where("nth = 1").drop("nth")
    again = F.row_number().over(W.partitionBy("query_id", F.lower(F.trim("topic"))).orderBy("rank")) > 1
    kept = kept.withColumn("deferred", F.coalesce(F.trim("topic") != "", F.lit(False)) & again)
    return kept.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("deferred", "rank")).cast("long"))


def with_quota(pool: DataFrame, top_k: int, preferred: Column) -> DataFrame:
    """The first ``top_k`` of each pool (by ``pos``), of which a third (rounded) are preferred ones if the pool has them.

    The next preferred ones of the pool take the places of the last ones that are not.
    """
    quota = max(1, (top_k + 2) // 3)
    own = W.partitionBy("query_id")
    p = pool.withColumn("wanted", preferred).withColumn("inside", F.col("pos") <= top_k)
    p = p.withColumn("short", F.lit(quota) - F.count_if(F.col("inside") & F.col("wanted")).over(own))
    nth_in = F.row_number().over(W.partitionBy("query_id", "inside", "wanted").orderBy("pos"))
    nth_out = F.row_number().over(W.partitionBy("query_id", "inside", "wanted").orderBy(F.desc("pos")))
    p = p.withColumns({"nth_in": nth_in, "nth_out": nth_out})
    available = F.least(F.col("short"), F.count_if(~F.col("inside") & F.col("wanted")).over(own), F.count_if(F.col("inside") & ~F.col("wanted")).over(own))
    p = p.withColumn("swaps", F.greatest(available, F.lit(0)))
    leaves = F.col("inside") & ~F.col("wanted") & (F.col("nth_out") <= F.col("swaps"))
    enters = ~F.col("inside") & F.col("wanted") & (F.col("nth_in") <= F.col("swaps"))
    # The k-th that enters takes the place of the k-th that leaves.
    p = p.withColumns({"leaves": leaves, "enters": enters})
    p = p.withColumn("k", F.when(F.col("leaves"), F.col("nth_out")).when(F.col("enters"), F.col("nth_in")))
    freed = F.max(F.when(F.col("leaves"), F.col("pos"))).over(W.partitionBy("query_id", "k"))
    place = F.when(F.col("enters"), freed).otherwise(F.col("pos"))
    p = p.withColumn("place", place).where(F.col("enters") | (F.col("inside") & ~F.col("leaves")))
    return p.select("query_id", "record_id", "place")


def neighbours(anchors: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Chunks of an anchor's document within ``radius`` ordinals, anchors left out, each at its first anchor.

    The range is opened into an equality join.
    """
    near = F.explode(F.array(*[F.lit(d) for d in range(-radius, radius + 1) if d])).alias("step")
    asked = anchors.select("query_id", "pos", "doc_id", F.col("ordinal").alias("from"), near)
    asked = asked.select("query_id", "pos", "doc_id", (F.col("from") + F.col("step")).alias("ordinal"), F.abs("step").cast("long").alias("distance"))
    found = asked.join(chunks.select("doc_id", "ordinal"), ["doc_id", "ordinal"])
    found = found.join(anchors.select("query_id", "doc_id", "ordinal"), ["query_id", "doc_id", "ordinal"], "left_anti")
    first = F.row_number().over(W.partitionBy("query_id", "doc_id", "ordinal").orderBy("pos", "distance"))
    return found.withColumn("nth", first).where("nth = 1").select("query_id", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("pos").cast("long").alias("anchor_pos"), "distance")


def budgeted(evidence: DataFrame, budget: int) -> DataFrame:
    """``(query_id, selected, estimated_tokens, n_omitted)``: what fits is taken in order, what does not is passed over."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "tokens", "record_id")))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc, x):
        fits = acc["used"] + x["tokens"] <= budget
        used = F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"])
        taken = F.when(fits, F.concat(acc["taken"], F.array(x["record_id"].cast("long")))).otherwise(acc["taken"])
        return F.struct(used.alias("used"), taken.alias("taken"))

    out = evidence.groupBy("query_id").agg(rows.alias("rows")).withColumn("plan", F.aggregate("rows", zero, step))
    return out.select(
        "query_id",
        F.array_join(F.col("plan.taken").cast("array<string>"), ",").alias("selected"),
        F.col("plan.used").alias("estimated_tokens"),
        (F.size("rows") - F.size("plan.taken")).cast("long").alias("n_omitted"),
    )


def expanded(anchors: DataFrame, chunks: DataFrame, radius: int = 1) -> DataFrame:
    """Anchors in their order, then the neighbours of each in the order of the anchors.

    ``anchors`` are (query_id, pos, doc_id, version, ordinal), ``chunks`` (doc_id, version, topic, ordinal). Neighbours
    are of the anchor's version and topic, nearest first, and each comes once, at its first anchor; an anchor without
    a chunk or a topic has none. ``distance`` is signed, and 0 for anchors.
    """
    known = chunks.select("doc_id", "version", "topic", "ordinal")
    small = F.broadcast if anchors.limit(ANCHORS + 1).count() <= ANCHORS else lambda rows: rows
    placed = known.where("topic <> ''").join(small(anchors), ["doc_id", "version", "ordinal"])
    steps = F.explode(F.array(*[F.lit(d).cast("long") for d in range(-radius, radius + 1) if d])).alias("distance")
    asked = placed.select("query_id", "pos", "doc_id", "version", "topic", F.col("ordinal").alias("from"), steps)
    asked = asked.select("query_id", "pos", "doc_id", "version", "topic", (F.col("from") + F.col("distance")).alias("ordinal"), "distance")
    found = known.join(small(asked), ["doc_id", "version", "topic", "ordinal"])
    found = found.join(anchors.select("query_id", "doc_id", "version", "ordinal"), ["query_id", "doc_id", "version", "ordinal"], "left_anti")
    best = F.min(F.struct("pos", F.abs("distance").alias("far"), "distance")).alias("at")
    found = found.groupBy("query_id", "doc_id", "version", "ordinal").agg(best).select("query_id", "doc_id", "version", "ordinal", "at.pos", "at.distance")
    own = anchors.select("query_id", "doc_id", "version", "ordinal", "pos", F.lit(0).cast("long").alias("distance"))
    order = W.partitionBy("query_id").orderBy(F.col("distance") != 0, "pos", F.abs("distance"), "ordinal")
    return own.unionByName(found).withColumn("place", F.row_number().over(order).cast("long"))
