"""Top-k routes: exact dense search, term overlap, BM25 and phrases; every route answers a batch of queries.

Terms are joined, never texts with queries. The terms of the queries decide which postings are looked at, and a
query's candidates are cut to its top k in each task before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.functions import text as T
from evidencespark.operators import nearest as near
from evidencespark.sources.shared import stored

#: The most queries that a task of the dense search holds (of the text search: about), and into how many blocks at least
#: the items are dealt.
QUERY_BLOCK, ITEM_BLOCKS = 4096, 16


def top_k(scored: DataFrame, k: int, query: str = "query_id", item: str = "record_id") -> DataFrame:
    """The ``k`` best rows of each query by ``score``, ties by ``item``, with their ``rank`` from 1."""
    order = W.partitionBy(query).orderBy(F.desc("score"), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def dense_topk(items: DataFrame, queries: DataFrame, k: int = 20, exclude_self: bool = False) -> DataFrame:
    """``(query_id, record_id, score, rank)``: exact cosine search of ``queries`` in ``items``.

    Both have ``(record_id | query_id, vector)``. Scores are rounded to 9 places before they are ranked; vectors that are
    zero score 0, as do null ones of queries, and those of different lengths never meet. Few queries go to every block
    of items, and only the best ``k`` leave a task; for more than one block of them items are put into lists, of which
    each query searches those that can hold one of its best (:mod:`.nearest`).
    """
    held = items.where(F.col("vector").isNotNull())
    widths = [r[0] for r in held.select(F.size("vector")).distinct().collect()]  # lengths of embeddings: one, or a few
    several = queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK
    search = near.nearest if several else _all_pairs
    found = None
    for width in widths or [1]:
        own = held.where(F.size("vector") == width)
        part = search(own, queries.where(F.col("vector").isNull() | (F.size("vector") == width)), k, exclude_self)
        found = part if found is None else found.unionByName(part)
    return top_k(found, k)


def _all_pairs(items: DataFrame, queries: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Each task holds the queries, multiplies them with batches of its items, and gives its best ``k`` of each query."""

    def unit(vectors, width):
        x = np.array([np.zeros(width) if v is None else v for v in vectors], dtype=float)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def found(ids, score, record):
        rows = pd.DataFrame({"query_id": np.repeat(ids, k), "record_id": record.ravel(), "score": score.ravel()})
        return rows[rows["score"] > -np.inf]

    def search(frames):
        block, asked, ids = None, [], None
        for frame in frames:
            for key, part in frame.groupby("item_block", sort=False):
                if key != block:
                    if ids is not None:
                        yield found(ids, score, record)
                    block, asked, ids = key, [], None
                asked.append(part[part["side"] == 0])
                held = part[part["side"] == 1].sort_values("id")
                if not len(held):
                    continue
                own = held["id"].to_numpy()
                x = unit(held["vector"], len(held["vector"].iloc[0]))
                if ids is None:  # a block's queries come before its items
                    rows = pd.concat(asked)
                    ids, q = rows["id"].to_numpy(), unit(rows["vector"], x.shape[1]) if len(rows) else None
                    score, record = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
                if q is None:
                    continue
                for a in range(0, len(ids), 512):
                    b = slice(a, a + 512)
                    scores = np.round(q[b] @ x.T, 9) + 0.0
                    if exclude_self:
                        scores[ids[b, None] == own[None, :]] = -np.inf
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    scores = np.concatenate((score[b], np.take_along_axis(scores, best, 1)), axis=1)
                    records = np.concatenate((record[b], own[best]), axis=1)
                    best = np.lexsort((records, -scores), axis=1)[:, :k]
                    score[b], record[b] = np.take_along_axis(scores, best, 1), np.take_along_axis(records, best, 1)
        if ids is not None:
            yield found(ids, score, record)

    def dealt(rows, name, side, block):
        return rows.select(F.col(name).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.lit(side).alias("side")).withColumn("item_block", block)

    blocks = max(ITEM_BLOCKS, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = dealt(items, "record_id", 1, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = dealt(queries, "query_id", 0, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = held.unionByName(asked).repartition("item_block").sortWithinPartitions("item_block", "side")
    return rows.mapInPandas(search, "query_id long, record_id long, score double")


#: Most distinct words of the queries that are broadcast to the texts; more of them are joined by a shuffle.
ASKED_WORDS = 200_000
#: Posting rows that a task of the text search holds and searches at once.
BLOCK_ROWS = 1 << 18
#: Texts that a task cuts, or searches, at once.
TEXTS = 2048
#: Posting rows of its rarest terms from which a query gets its first threshold.
SEED_ROWS = 4096


def _few(words: DataFrame) -> bool:
    return words.limit(ASKED_WORDS + 1).count() <= ASKED_WORDS


@dataclass(frozen=True)
class TextIndex:
    """The part of an inverted index that a batch of queries asks for; the texts are read and cut once to make it.

    ``postings`` are (record_id, term, part): what a term adds to the score of a text, whatever the query. ``asked`` are
    (query_id, term, df, idf), ``average`` is the mean number of terms of a text, and ``weigh`` gives the part of a
    count in a text of some length. ``texts`` are (record_id, length, terms, times), a row for each text, from which texts
    are searched where they lie; there are none where ids repeat or the words of the queries are too many.
    """

    postings: DataFrame
    asked: DataFrame
    average: float
    weigh: Callable
    texts: DataFrame | None = None


def _counted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(record_id, length, terms, times)`` of each text: its number of terms, and how often it has each wanted one."""
    known = docs.sparkSession.sparkContext.broadcast(wanted.toArrow().column(0).cast(pa.string()).combine_chunks())  # ASKED_WORDS at most

    def run(batches):
        names = known.value
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                ids, terms = (batch.column(i).slice(a, TEXTS) for i in range(2))
                length = pc.list_value_length(terms).to_numpy()
                code = pc.fill_null(pc.index_in(terms.flatten().cast(pa.string()), value_set=names), -1).to_numpy()
                own = np.repeat(np.arange(len(ids)), length)[code >= 0] * max(len(names), 1) + code[code >= 0]
                own, times = np.unique(own, return_counts=True)
                ends = pa.array(np.searchsorted(own, np.arange(len(ids) + 1) * max(len(names), 1)).astype(np.int32))
                words = names.take(pa.array(own % max(len(names), 1)))
                columns = [ids, pa.array(length, pa.int32()), pa.ListArray.from_arrays(ends, words), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["record_id", "length", "terms", "times"])

    cut = docs.select("record_id", F.coalesce(T.terms(F.col("text")), F.array().cast("array<string>")).alias("terms"))
    return cut.mapInArrow(run, f"record_id {cut.schema['record_id'].dataType.simpleString()}, length int, terms array<string>, times array<long>")


def _text_blocks(batches, names: pa.Array, idf: np.ndarray, weigh: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Postings (text, number of the term, part) of runs of whole texts ``(record_id, length, terms, times)``, sorted by text."""
    for batch in batches:
        for a in range(0, batch.num_rows, TEXTS):
            part = batch.slice(a, TEXTS)
            part = part.take(pc.sort_indices(part.column(0)))
            sizes = pc.list_value_length(part.column(2)).to_numpy()
            number = pc.fill_null(pc.index_in(part.column(2).flatten().cast(pa.string()), value_set=names), -1).to_numpy()
            ids, length = (np.repeat(part.column(i).to_numpy(), sizes)[number >= 0] for i in range(2))
            times, number = part.column(3).flatten().to_numpy()[number >= 0], number[number >= 0]
            yield ids, number, weigh(idf[number], times, length)


def _numbered(index: TextIndex, asked: DataFrame) -> tuple[pa.Table, pa.Array, np.ndarray] | None:
    """The rows of ``asked`` with numbers of their terms, and the terms with their idf, if texts can be searched where they lie."""
    if index.texts is None or not _few(asked) or asked.select("query_id").distinct().count() > QUERY_BLOCK:
        return None
    rows = asked.toArrow()  # a bound on what the driver gets
    term = rows.column("term").cast(pa.string()).combine_chunks()
    names = pc.unique(term)
    number = pc.index_in(term, value_set=names).to_numpy()
    idf = np.zeros(len(names))
    idf[number] = rows.column("idf").to_numpy()
    return rows.append_column("number", pa.array(number, pa.int64())), names, idf


def text_index(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> TextIndex:
    """BM25 over ``docs(record_id, text)`` for ``queries(query_id, query)``.

    Null texts count as texts without terms. A text keeps the terms that some query has, and one row that marks it.
    """
    spark = docs.sparkSession
    asked = stored(queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term")), "asked")
    wanted = asked.select("term").union(spark.createDataFrame([("",)], "term string")).distinct()
    once = docs.groupBy("record_id").count().where("count > 1").isEmpty()
    texts = stored(_counted(docs, wanted.where("term <> ''")), "texts") if once and _few(wanted) else None
    if texts is not None:
        counts = texts.select("record_id", "length", F.explode(F.arrays_zip("terms", "times")).alias("t")).select("record_id", F.col("t.terms").alias("term"), F.col("t.times").alias("tf"), "length")
        n_docs, average = texts.agg(F.count(F.lit(1)), F.avg("length")).first()
    else:
        each = docs.select("record_id", F.coalesce(T.terms(F.col("text")), F.array().cast("array<string>")).alias("terms"))
        rows = each.select("record_id", F.size("terms").alias("length"), F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
        rows = rows.join(F.broadcast(wanted) if _few(wanted) else wanted, "term", "left_semi")
        counts = stored(rows.groupBy("record_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length")), "postings")
        n_docs, average = counts.where("term = ''").agg(F.count(F.lit(1)), F.avg("length")).first()
    average = average or 1.0
    df = counts.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = stored(df.withColumn("idf", idf), "terms")

    def weigh(weight, times, length):  # columns or arrays
        return weight * times / (times + k1 * (1 - b + b * length / average))

    small = F.broadcast(terms) if _few(terms) else terms
    parts = counts.join(small, "term").select("record_id", "term", weigh(F.col("idf"), F.col("tf"), F.col("length")).alias("part"))
    return TextIndex(parts if texts is not None else stored(parts, "parts"), stored(asked.join(small, "term"), "asked-terms"), average, weigh, texts)


def _thresholds(index: TextIndex, k: int) -> DataFrame:
    """``(query_id, floor)``: a score that ``k`` texts have at least, by the sums over a query's rarest terms alone."""
    rare = W.partitionBy("query_id").orderBy("df", "term")
    seeds = index.asked.withColumn("rows", F.sum("df").over(rare)).where(F.col("rows") <= SEED_ROWS).select("query_id", "term")
    sums = index.postings.join(F.broadcast(seeds) if _few(seeds) else seeds, "term").groupBy("query_id", "record_id").agg(F.sum("part").alias("sum"))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sum")))
    return sums.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", F.col("sum").alias("floor"))


class _Asked:
    """A block of queries in a task: their terms, the best ``k`` texts so far, and the scores that are still of use."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, floors: np.ndarray, k: int, digits: int):
        self.ids, first = np.unique(ids, return_index=True)
        self.ends = np.append(first, len(ids))
        self.terms, self.floor, self.k, self.digits = terms, floors[first].copy(), k, digits
        self.best = [(np.zeros(0), np.zeros(0, np.int64)) for _ in self.ids]
        self.slack = 2.0 * 10.0**-digits if digits else 0.0  # whole numbers add up exactly

    def search(self, ids: np.ndarray, terms: np.ndarray, parts: np.ndarray) -> int:
        """Take whole texts in, sorted by id; returns how many pairs of a query and a text were scored."""
        texts, at = np.unique(ids, return_inverse=True)
        by_term = np.argsort(terms, kind="stable")
        names, begin = np.unique(terms[by_term], return_index=True)
        where, part = at[by_term], parts[by_term]
        most = np.maximum.reduceat(part, begin)
        end = np.append(begin[1:], len(terms))
        place = np.minimum(np.searchsorted(names, self.terms), len(names) - 1)
        known = names[place] == self.terms
        scored = 0
        for q in range(len(self.ids)):
            own = slice(self.ends[q], self.ends[q + 1])
            lists = place[own][known[own]]
            least = self.floor[q] - self.slack
            if not len(lists) or most[lists].sum() < least:
                continue  # no text of this block can come in
            lists = lists[np.argsort(most[lists], kind="stable")]
            upto = np.cumsum(most[lists])
            common = int(np.searchsorted(upto, least))  # texts with these terms alone stay below
            sums = np.zeros(len(texts))
            for x in lists[common:]:
                sums[where[begin[x] : end[x]]] += part[begin[x] : end[x]]
            found = np.flatnonzero(sums)
            for i in range(common - 1, -1, -1):
                found = found[sums[found] + upto[i] >= least]
                a, b = begin[lists[i]], end[lists[i]]
                if len(found) * 16 < b - a:
                    hit = np.minimum(np.searchsorted(where[a:b], found), b - a - 1)
                    same = where[a:b][hit] == found
                    sums[found[same]] += part[a:b][hit[same]]
                else:
                    sums[where[a:b]] += part[a:b]
            found = found[sums[found] >= least]
            scored += len(found)
            score, record = self.best[q]
            score, record = np.append(score, np.round(sums[found], self.digits)), np.append(record, texts[found])
            top = np.lexsort((record, -score))[: self.k]
            self.best[q] = score[top], record[top]
            if len(top) == self.k:
                self.floor[q] = max(self.floor[q], score[top[-1]])
        return scored

    def rows(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.best]
        parts = [np.repeat(self.ids, sizes), np.concatenate([r for _, r in self.best]), np.concatenate([s for s, _ in self.best])]
        return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())], names=["query_id", "record_id", "score"])


def _searched_in_place(index: TextIndex, own: tuple[pa.Table, pa.Array, np.ndarray], k: int, digits: int) -> DataFrame:
    """:func:`pruned_topk` for one block of queries, which goes to every task of the texts."""
    rows, names, idf = own
    floors = {r["query_id"]: r["floor"] for r in _thresholds(index, k).collect()}  # a row for each query at most
    ids = rows.column("query_id").to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    value = np.array([floors.get(i, 0.0) for i in ids.tolist()])[order]
    asked = index.postings.sparkSession.sparkContext.broadcast((ids[order], rows.column("number").to_numpy()[order], value, names, idf))
    weigh = index.weigh

    def run(batches):
        ids, numbers, floor, names, idf = asked.value
        queries = _Asked(ids, numbers, floor, k, digits)
        for block in _text_blocks(batches, names, idf, weigh):
            if len(block[0]):
                queries.search(*block)
        if len(queries.ids):
            yield queries.rows()

    texts = index.texts.select(F.col("record_id").cast("long").alias("record_id"), "length", "terms", "times")
    return texts.mapInArrow(run, "query_id long, record_id long, score double")


def pruned_topk(index: TextIndex, k: int, digits: int) -> DataFrame:
    """``(query_id, record_id, score)``: of each task the best ``k`` texts of each query by summed parts, among which are the
    best ones of all; scores are rounded to ``digits`` before they are compared.

    Queries and texts are dealt into blocks, a task for each pair of blocks, and a block of queries gets the postings
    that one of them asks for. A text is scored for a query only if the largest parts of its terms can lift it over
    the k-th score so far: a run of texts is skipped if the largest parts in it cannot, texts that share nothing but
    common words with the query are not looked at, and others are left as soon as what is still to come is too little.
    The first threshold comes from the query's rarest terms. No pair leaves a task but the best ``k``.
    """
    spark = index.postings.sparkSession
    own = _numbered(index, index.asked)
    if own is not None:
        return _searched_in_place(index, own, k, digits)
    item_blocks = max(ITEM_BLOCKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = index.asked.select("query_id").distinct()
    query_blocks = max(-(-ids.count() // QUERY_BLOCK), 1)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    names = stored(index.asked.select("term").distinct().withColumn("number", F.monotonically_increasing_id()), "term-numbers")
    small = F.broadcast(names) if _few(names) else names
    floors = _thresholds(index, k)
    asked = index.asked.join(small, "term").join(floors, "query_id", "left").withColumn("query_block", block("query_id", query_blocks))
    asked = stored(asked.select("query_block", F.col("query_id").cast("long").alias("id"), "number", F.coalesce("floor", F.lit(0.0)).alias("value")), "asked-blocks")
    by_block = asked.select("query_block", "number").distinct()
    held = index.postings.join(small, "term").withColumn("item_block", block("record_id", item_blocks))
    held = held.join(F.broadcast(by_block) if _few(by_block) else by_block, "number")
    columns = ["query_block", "item_block", "side", "id", "number", "value"]
    held = held.select("query_block", "item_block", F.lit(1).alias("side"), F.col("record_id").cast("long").alias("id"), "number", F.col("part").alias("value"))
    copies = asked.withColumns({"item_block": F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))), "side": F.lit(0)}).select(*columns)

    def run(batches):
        pair, queries, asked_rows, held_rows, n_held = None, None, [], [], 0

        def searched(everything: bool):
            nonlocal queries, held_rows, n_held
            if queries is None:
                queries = _Asked(*(np.concatenate(x) for x in zip(*asked_rows, strict=True)), k, digits) if asked_rows else None
            if queries is None or not held_rows:
                held_rows, n_held = [], 0
                return
            ids, terms, parts = (np.concatenate(x) for x in zip(*held_rows, strict=True))
            cut = len(ids) if everything else int(np.searchsorted(ids, ids[-1]))  # the last text may go on
            if cut:
                queries.search(ids[:cut], terms[:cut], parts[:cut])
            held_rows, n_held = [(ids[cut:], terms[cut:], parts[cut:])], len(ids) - cut

        for batch in batches:
            a, b, side, ids, terms, values = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            borders = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (side[1:] != side[:-1])) + 1
            for i, j in zip([0, *borders.tolist()], [*borders.tolist(), len(a)], strict=True):
                if i == j:
                    continue
                if (a[i], b[i]) != pair:
                    if pair is not None:
                        searched(True)
                        if queries is not None:
                            yield queries.rows()
                    pair, queries, asked_rows, held_rows, n_held = (a[i], b[i]), None, [], [], 0
                if side[i] == 0:  # a pair's queries come before its texts
                    asked_rows.append((ids[i:j], terms[i:j], values[i:j]))
                    continue
                held_rows.append((ids[i:j], terms[i:j], values[i:j]))
                n_held += j - i
                if n_held >= BLOCK_ROWS:
                    searched(False)
        if pair is not None:
            searched(True)
            if queries is not None:
                yield queries.rows()

    keys = ["query_block", "item_block"]
    pairs = held.select(*columns).unionByName(copies).repartition(*keys).sortWithinPartitions(*keys, "side", "id")
    return pairs.mapInArrow(run, "query_id long, record_id long, score double")


def overlap_topk(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, record_id, score, rank)``: the share of a query's distinct words that a text holds.

    Texts keep only the words that some query has before anything is shuffled; see :func:`pruned_topk`.
    """
    asked = stored(queries.select("query_id", F.explode(T.words(F.col("query"))).alias("term")), "asked-words")
    wanted = asked.select("term").distinct()
    held = docs.select("record_id", F.explode(T.words(F.col("text"))).alias("term"))
    held = stored(held.join(F.broadcast(wanted) if _few(wanted) else wanted, "term", "left_semi").withColumn("part", F.lit(1.0)), "words")
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    index = TextIndex(held, stored(asked.join(counts, "term").select("query_id", "term", "df"), "asked-terms"), 1.0, None)
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    found = pruned_topk(index, k, 0).join(sizes, "query_id")
    return top_k(found.select("query_id", "record_id", F.round(F.col("score") / F.col("n"), 9).alias("score")), k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 20, k1: float = 1.2, b: float = 0.75, phrase_boost: float = 0.0) -> DataFrame:
    """``(query_id, record_id, score, rank)`` by BM25 over all of ``docs``; scores rounded to 6 places.

    With a ``phrase_boost``, a text that holds all terms of the query one after another gets the score of that phrase, so
    weighted, on top.
    """
    index = text_index(docs, queries, k1, b)
    return ranked_texts(index, phrase_bonus(index, docs, queries, phrase_boost) if phrase_boost else None, k)


def ranked_texts(index: TextIndex, bonus: DataFrame | None, k: int) -> DataFrame:
    """``(query_id, record_id, score, rank)`` of an index, with what :func:`phrase_bonus` adds."""
    found = pruned_topk(index, k, 6)
    if bonus is None:
        return top_k(found, k)
    # A text that a bonus lifts may not be among the best without it, so those are scored by themselves.
    lifted = pair_scores(index, bonus.select("query_id", "record_id")).join(bonus, ["query_id", "record_id"])
    lifted = lifted.select("query_id", "record_id", F.round(F.col("score") + F.col("bonus"), 6).alias("score"))
    plain = found.join(bonus.select("query_id", "record_id"), ["query_id", "record_id"], "left_anti")
    return top_k(plain.unionByName(lifted), k)


def pair_scores(index: TextIndex, pairs: DataFrame) -> DataFrame:
    """``pairs`` with their ``score`` (rounded to 6 places); pairs that share no term have no row."""
    own = index.asked.select("query_id", "term")
    ids = pairs.select("record_id").distinct()
    held = index.postings.join(F.broadcast(ids) if _few(ids) else ids, "record_id", "left_semi")
    both = pairs.join(own, "query_id").join(held, ["record_id", "term"])
    return both.groupBy(*pairs.columns).agg(F.round(F.sum("part"), 6).alias("score"))


def _pairs_in_place(index: TextIndex, queries: DataFrame, own: tuple[pa.Table, pa.Array, np.ndarray]) -> DataFrame:
    """:func:`_phrase_pairs` for one block of queries, which goes to every task of the texts."""
    rows, names, idf = own
    sizes = dict(map(tuple, queries.select("query_id", F.size(F.array_distinct(T.terms(F.col("query"))))).collect()))  # one block at most
    terms: dict[int, list] = {}
    for query, df, number in zip(*(rows.column(c).to_pylist() for c in ("query_id", "df", "number")), strict=True):
        terms.setdefault(query, []).append((df, number))
    whole = [(q, np.array([n for _, n in sorted(x)])) for q, x in terms.items() if len(x) == sizes.get(q)]
    asked = index.postings.sparkSession.sparkContext.broadcast((whole, names, idf))
    weigh = index.weigh

    def run(batches):
        whole, names, idf = asked.value
        for ids, numbers, _ in _text_blocks(batches, names, idf, weigh):
            order = np.argsort(numbers, kind="stable")
            ends, ids = np.searchsorted(numbers[order], np.arange(len(names) + 1)), ids[order]
            found = []
            for query, wanted in whole:
                have = ids[ends[wanted[0]] : ends[wanted[0] + 1]]
                for n in wanted[1:]:
                    if not len(have):
                        break
                    have = np.intersect1d(have, ids[ends[n] : ends[n + 1]], assume_unique=True)
                found += [(query, i) for i in have.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["query_id", "record_id"])

    texts = index.texts.select(F.col("record_id").cast("long").alias("record_id"), "length", "terms", "times")
    kinds = [f"CAST({c} AS {x.schema[c].dataType.simpleString()}) AS {c}" for c, x in (("query_id", index.asked), ("record_id", index.texts))]
    return stored(texts.mapInArrow(run, "query_id long, record_id long").selectExpr(*kinds), "phrase-pairs")


def _phrase_pairs(index: TextIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, record_id)`` of the texts that hold every term of a query: those of its rarest term are looked at."""
    own = _numbered(index, index.asked)
    if own is not None:
        return _pairs_in_place(index, queries, own)
    sizes = queries.select("query_id", F.size(F.array_distinct(T.terms(F.col("query")))).alias("n_terms"))
    rarest = index.asked.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count(F.lit(1)).alias("n_known"))
    rarest = rarest.join(sizes, "query_id").where("n_known = n_terms")
    pairs = index.postings.select("record_id", "term").join(rarest.select("query_id", "term", "n_terms"), "term").drop("term")
    both = pairs.join(index.asked.select("query_id", "term"), "query_id").join(index.postings.select("record_id", "term"), ["record_id", "term"])
    return both.groupBy("query_id", "record_id").agg(F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms")).where("n = n_terms").select("query_id", "record_id")


def phrase_hits(docs: DataFrame, queries: DataFrame, index: TextIndex | None = None) -> DataFrame:
    """``(query_id, record_id, times, length)``: the texts that hold all terms of a query one after another, how often
    (without overlap), and their number of terms.

    Only texts that have all terms of a query are cut into terms again.
    """
    pairs = _phrase_pairs(index or text_index(docs, queries), queries)
    asked = queries.select("query_id", T.terms(F.col("query")).alias("wanted"))
    ids = pairs.select("record_id").distinct()
    held = docs.select("record_id", "text").join(F.broadcast(ids) if _few(ids) else ids, "record_id", "left_semi").select("record_id", T.terms(F.col("text")).alias("terms"))
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(c, "  "), F.lit(" "))  # noqa: E731 - each term between blanks of its own
    times = (F.length(spaced(F.col("terms"))) - F.length(F.replace(spaced(F.col("terms")), spaced(F.col("wanted")), F.lit("")))) / F.length(spaced(F.col("wanted")))
    found = pairs.join(asked, "query_id").join(held, "record_id").select("query_id", "record_id", times.cast("long").alias("times"), F.size("terms").alias("length"))
    return found.where("times > 0")


def phrase_bonus(index: TextIndex, docs: DataFrame, queries: DataFrame, boost: float) -> DataFrame:
    """``(query_id, record_id, bonus)``: the weighted BM25 score of the query as one term, for the texts that hold it."""
    weights = index.asked.groupBy("query_id").agg(F.sum("idf").alias("idf"))
    hits = phrase_hits(docs, queries, index).join(weights, "query_id")
    bonus = F.round(boost * index.weigh(F.col("idf"), F.col("times"), F.col("length")), 6)
    return stored(hits.select("query_id", "record_id", bonus.alias("bonus")), "phrases")
