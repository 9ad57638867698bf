"""The whole retrieval of a batch of queries as one plan.

Analysis, two routes for each subquery, visibility, fusion, identifiers, rerank, diversity and quota, references of
index entries, neighbours in topics, and the context budget. Order is carried by keys instead of lists: a piece of
evidence stands at (place of its anchor, kind, place within), with the neighbours' kind behind all anchors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.functions import text as T
from evidencespark.operators import analysis, fuse, lifecycle, search
from evidencespark.sources.shared import stored

#: How many fused candidates are reranked, the weight of a phrase, and what hints add for a reference.
RERANKED, PHRASE_BOOST = 20, 10.0
REFERENCE_PHRASE, REFERENCE_MATCH, REFERENCE_ANCHOR = 12.0, 4.0, 25.0
#: Most candidates of references by anchor and in all.
REFERENCES_EACH, REFERENCES_ALL = 12, 100
#: Intents whose answers keep a third of their anchors for narrative files.
NARRATIVE = ("general", "installation", "configuration", "troubleshooting", "performance_tuning")
#: Most rows of candidates that are broadcast to the chunks.
CANDIDATES = 200_000
CHUNKS = ("record_id", "doc_id", "version", "ordinal", "text", "source_name", "source_type", "topic_path", "topic_title", "topic_url", "symbol", "associated_source", "anchor")


@dataclass(frozen=True)
class Settings:
    top_k: int = 6
    budget: int = 4000
    rerank: bool = True


def _described(rows: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with columns of their chunks; few rows go to the chunks, many are joined by a shuffle."""
    few = rows.limit(CANDIDATES + 1).count() <= CANDIDATES
    return chunks.select("record_id", *columns).join(F.broadcast(rows) if few else rows, "record_id")


def identifiers(text: Column) -> Column:
    """The distinct lower-cased names of five characters or more with an underscore."""
    names = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[A-Za-z][A-Za-z0-9_]{4,}(?![\p{L}\p{N}_])"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(names, lambda x: F.contains(x, F.lit("_"))), F.lower))


def prioritized(candidates: DataFrame) -> DataFrame:
    """``candidates`` with ``exact``, ``occurrences`` and ``rank``: those that name an identifier of the query come first.

    Exact fields (symbol, topic title, topic address) count before occurrences in the text and the fields, then the
    fusion score and the record. Without identifiers the fusion's order stays.
    """
    ids = identifiers(F.col("normalized"))
    fields = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("symbol", "topic_title", "topic_url")]
    whole = F.lower(F.concat_ws("\n", F.coalesce("text", F.lit("")), *[F.coalesce(F.col(c), F.lit("")) for c in ("symbol", "topic_title", "topic_url")]))
    zero = F.lit(0).cast("long")
    exact = F.aggregate(ids, zero, lambda s, x: s + sum((f == x).cast("long") for f in fields))
    times = F.aggregate(ids, zero, lambda s, x: s + fuse.occurrences(whole, x))
    order = W.partitionBy("query_id").orderBy(F.desc("exact"), F.desc("occurrences"), F.desc("fusion_score"), "record_id")
    return candidates.withColumns({"exact": exact, "occurrences": times}).withColumn("rank", F.row_number().over(order).cast("long"))


def _route(hits: DataFrame, chunks: DataFrame, active: DataFrame) -> DataFrame:
    """A route's rankings of subqueries, each without what is not visible, as one ranking."""
    hits = hits.select(F.floor(F.col("query_id") / 4).cast("long").alias("query_id"), (F.col("query_id") % 4).alias("subquery"), "record_id", "rank", "score")
    seen = lifecycle.visible(_described(hits, chunks, F.col("doc_id").alias("document_id"), "version"), active)
    again = F.row_number().over(W.partitionBy("query_id", "subquery").orderBy("rank"))
    return fuse.merge_routes(seen.withColumn("rank", again)).select("query_id", "record_id", "rank", F.col("score").alias("raw"))


def references(anchors: DataFrame, chunks: DataFrame, active: DataFrame, index: search.TextIndex, bonus: DataFrame) -> DataFrame:
    """``(query_id, place, record_id)``: for anchors that are index entries, the best visible chunk of the topic they name.

    ``anchors`` have (query_id, place, source_type, associated_source, topic_path, anchor); ``index`` and ``bonus`` score the
    chunks for the normalized queries. All candidates of a query are ranked together, a chunk that several entries
    name by the sum of its scores, and the best ones of them are looked at (12 for each entry, 100 at most).
    """
    entries = anchors.where("source_type = 'chi' AND coalesce(associated_source, '') <> '' AND coalesce(topic_path, '') <> ''")
    entries = entries.select("query_id", "place", F.col("associated_source").alias("source_name"), "topic_path", F.col("anchor").alias("wanted"))
    few = entries.limit(CANDIDATES + 1).count() <= CANDIDATES
    topics = lifecycle.visible(chunks.where("source_type = 'chm'").withColumnRenamed("doc_id", "document_id"), active)
    found = topics.select("record_id", "ordinal", "source_name", "topic_path", "anchor").join(F.broadcast(entries) if few else entries, ["source_name", "topic_path"])
    found = stored(found.select("query_id", "place", "record_id", "ordinal", F.coalesce(F.col("wanted") == F.col("anchor"), F.lit(False)).alias("same_anchor")), "reference-candidates")
    pairs = found.select("query_id", "record_id").distinct()
    scores = search.pair_scores(index, pairs).withColumnRenamed("score", "match")
    scored = found.join(scores, ["query_id", "record_id"], "left").join(bonus, ["query_id", "record_id"], "left")
    hint = 1 + REFERENCE_MATCH * F.coalesce("match", F.lit(0.0)) + REFERENCE_PHRASE * F.coalesce("bonus", F.lit(0.0)) + F.when(F.col("same_anchor"), REFERENCE_ANCHOR).otherwise(0.0)
    total = F.round(F.sum(hint).over(W.partitionBy("query_id", "record_id")), 5)
    by_score = W.partitionBy("query_id").orderBy(F.desc("total"), "ordinal", "record_id")
    ranked = scored.withColumn("total", total).withColumn("nth", F.dense_rank().over(by_score))
    entry_count = entries.groupBy("query_id").agg(F.least(F.count(F.lit(1)) * REFERENCES_EACH, F.lit(REFERENCES_ALL)).alias("most"))
    ranked = ranked.join(entry_count, "query_id").where("nth <= most")
    return ranked.groupBy("query_id", "place").agg(F.min_by("record_id", "nth").alias("record_id"))


def with_references(anchors: DataFrame, found: DataFrame) -> DataFrame:
    """``(query_id, record_id, place, kind, cause)``: anchors (kind 0), each reference (1) after the entry that names it.

    A reference that is an anchor itself is not repeated: ``cause`` of that anchor is then the first entry that names it.
    One that several entries name stands after the first.
    """
    first = found.groupBy("query_id", "record_id").agg(F.min("place").alias("named"))
    own = anchors.select("query_id", "record_id", "place", "source_type").join(first, ["query_id", "record_id"], "left")
    entries = anchors.select("query_id", F.col("place").alias("named"), F.col("record_id").alias("entry"))
    direct = own.where("source_type <> 'chi'").select("query_id", "record_id", F.lit(True).alias("direct"))
    kept = own.join(entries, ["query_id", "named"], "left")
    kept = kept.select("query_id", "record_id", "place", F.lit(0).alias("kind"), F.when(F.col("source_type") != "chi", F.col("entry")).alias("cause"))
    new = first.join(direct, ["query_id", "record_id"], "left_anti").join(entries, ["query_id", "named"])
    return kept.unionByName(new.select("query_id", "record_id", F.col("named").alias("place"), F.lit(1).alias("kind"), F.col("entry").alias("cause")))


def fitted(evidence: DataFrame, budget: int) -> DataFrame:
    """``evidence`` with ``selected``: in the order of ``position``, what fits is taken and what does not is passed over."""
    rows = F.sort_array(F.collect_list(F.struct("position", "tokens")))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc, x):
        fits = acc["used"] + x["tokens"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["tokens"]).alias("used"), F.concat(acc["taken"], F.array(x["position"])).alias("taken"))).otherwise(acc)

    plan = evidence.groupBy("query_id").agg(F.aggregate(rows, zero, step)["taken"].alias("taken"))
    return evidence.join(plan, "query_id").withColumn("selected", F.array_contains("taken", F.col("position"))).drop("taken")


@dataclass(frozen=True)
class Retrieved:
    """The stages of a plan: ``ranked`` candidates, ``anchors`` with their place, ``evidence`` in its order."""

    ranked: DataFrame
    anchors: DataFrame
    evidence: DataFrame


def retrieve(chunks: DataFrame, queries: DataFrame, active: DataFrame, settings: Settings | None = None, vocabulary: analysis.Vocabulary | None = None) -> Retrieved:
    """Evidence for ``queries(query_id, query)`` from ``chunks``, of which only the ``active`` versions are visible.

    ``chunks`` have the columns ``CHUNKS`` and ``vector``; ``active`` is (document_id, active_version). Ids are whole
    numbers. A blank query has no rows. Evidence has (query_id, position, record_id, role, cause, distance,
    fusion_score, rerank_score, tokens, selected): ``cause`` is the entry or anchor that brought it, for an anchor the
    entry that names it, too; scores are those of anchors. Where a word of the query is in no candidate, its rerank score is 0.
    """
    s = settings or Settings()
    limit = fuse.over_fetch(s.top_k)
    asked = stored(analysis.analyzed(queries.select("query_id", "query"), vocabulary).where("original IS NOT NULL").select("query_id", "query", "normalized", "intent", "subqueries"), "analyzed")
    subs = asked.select("query_id", F.posexplode("subqueries").alias("nth", "query"))
    subs = stored(subs.select((F.col("query_id") * 4 + F.col("nth")).alias("query_id"), "query"), "subqueries")  # three at most
    dense = search.dense_topk(chunks.select("record_id", "vector"), subs.select("query_id", T.digest_vector(F.col("query")).alias("vector")), limit)
    index = search.text_index(chunks.select("record_id", "text"), subs)
    bonus = search.phrase_bonus(index, chunks, subs, PHRASE_BOOST)
    sparse = search.ranked_texts(index, bonus, limit)
    routes = [_route(stored(r, "route"), chunks, active) for r in (dense, sparse)]
    fused = stored(fuse.rrf([(r, 1.0) for r in routes]).drop("rank"), "fused")
    full = _described(fused, chunks, "text", "source_type", "topic_path", "topic_title", "topic_url", "symbol").join(asked.drop("subqueries"), "query_id")
    ranked = prioritized(full)
    if s.rerank:
        words = T.words(F.col("query"))
        score = F.round(F.size(F.array_intersect(words, T.words(F.col("text")))) / F.greatest(F.size(words), F.lit(1)), 9)
        ranked = fuse.rerank(ranked.where(F.col("rank") <= RERANKED).withColumn("rerank_score", score), RERANKED)
    else:
        ranked = ranked.withColumn("rerank_score", F.lit(None).cast("double"))
    columns = ["query_id", "record_id", "rank", "exact", "occurrences", "fusion_score", "rerank_score", "intent", "source_type"]
    ranked = stored(ranked.select(*columns, F.sha2("text", 256).alias("content_sha256"), F.col("topic_path").alias("topic")), "ranked")
    pool = fuse.diversified(ranked)
    narrative = (F.col("source_type") == "pdf") & F.col("intent").isin(*NARRATIVE) & F.lit(s.top_k >= 3)
    chosen = fuse.with_quota(pool, s.top_k, narrative)
    anchors = _described(chosen, chunks, "doc_id", "version", "ordinal", "source_type", "associated_source", "topic_path", "anchor")
    anchors = stored(anchors, "anchors")
    # References are scored for the normalized query, which is each query's first subquery.
    first = lambda rows: rows.where("query_id % 4 = 0").withColumn("query_id", F.floor(F.col("query_id") / 4).cast("long"))
    normal = search.TextIndex(index.postings, first(index.asked), index.average, index.weigh, index.texts)
    named = references(anchors, chunks, active, normal, first(bonus).withColumn("bonus", F.col("bonus") / PHRASE_BOOST))
    listed = stored(with_references(anchors, named), "listed")
    places = _described(listed, chunks, "doc_id", "version", "ordinal")
    order = F.row_number().over(W.partitionBy("query_id").orderBy("place", "kind", "record_id")).cast("long")
    places = stored(places.withColumn("pos", order), "places")
    topical = chunks.select("record_id", "doc_id", "version", F.when((F.col("source_type") == "chm") & F.col("topic_path").isNotNull(), F.col("topic_path")).otherwise("").alias("topic"), "ordinal")
    spread = stored(fuse.expanded(places.select("query_id", "pos", "doc_id", "version", "ordinal"), topical), "spread")
    spread = spread.join(places.select("query_id", "pos", F.col("record_id").alias("at"), "kind", F.col("cause").alias("_cause")), ["query_id", "pos"])
    known = topical.select("record_id", "doc_id", "version", "ordinal")
    few = spread.limit(CANDIDATES + 1).count() <= CANDIDATES
    rows = known.join(F.broadcast(spread) if few else spread, ["doc_id", "version", "ordinal"])
    role = F.when(F.col("distance") != 0, "neighbour").when(F.col("kind") == 1, "reference").otherwise("anchor")
    cause = F.when(F.col("distance") != 0, F.col("at")).otherwise(F.col("_cause"))
    rows = rows.select("query_id", F.col("place").alias("position"), "record_id", role.alias("role"), cause.alias("cause"), "distance")
    rows = _described(stored(rows, "evidence"), chunks, T.token_estimate(F.col("text")).alias("tokens"))
    scores = ranked.select("query_id", "record_id", "fusion_score", "rerank_score", F.lit("anchor").alias("role"))
    return Retrieved(ranked, anchors, fitted(rows.join(scores, ["query_id", "record_id", "role"], "left"), s.budget))
