"""Exact nearest neighbours by cosine from lists around centres, for many queries.

Angles between unit vectors obey the triangle inequality: no item of a list is nearer to a query than the angle to the
list's centre less the list's radius. A query first searches the lists nearest to it, which gives a score that its
``k``-th neighbour has at least, and then those of all other lists whose bound reaches that score. Nothing else is
scored, and nothing is lost: the result is that of comparing every pair.

Lists near to each other make up blocks of items, and queries with a near list in common blocks of queries. A vector goes
once to each block that it meets, whatever the number of lists that are searched there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.sources.shared import stored

#: The centres are fitted on a sample of this many items at most, in a fixed number of rounds; every item is in a list.
SAMPLE, ROUNDS = 32_768, 6
#: Most bytes of centres, which every task has.
CENTRE_BYTES = 64 << 20
#: Most bytes of the vectors of a block (of items or queries) that a task holds, and most and least rows of one.
BLOCK_BYTES, BLOCK_ROWS, LEAST_ROWS = 32 << 20, 65_536, 1024
#: Into how many blocks at least the items are dealt, if these have that many rows.
BLOCKS = 8
_SLACK = 2e-9


def unit_rows(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows; zeros stay zeros."""
    flat, n = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), len(vectors)
    x = flat.reshape(n, -1) if n and len(flat) else np.zeros((n, 1))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def fitted_centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centres of spherical k-means, from evenly spaced rows of ``sample``."""
    sample = sample[np.linalg.norm(sample, axis=1) > 0]
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = np.unique(sample[np.linspace(0, len(sample) - 1, min(lists, len(sample))).astype(int)], axis=0)
    for _ in range(ROUNDS):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0), centres)
    return centres


def _blocks(count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each list the number of its first block and how many it has: those with more than ``rows`` rows are cut, the
    others share blocks with their neighbours."""
    first, parts = np.zeros(len(count), np.int64), np.maximum(-(-count // rows), 1)
    block, used = 0, 0
    for i, n in enumerate(count.tolist()):
        if used and used + n > rows:
            block, used = block + 1, 0
        first[i] = block
        used += n
        if parts[i] > 1:
            block, used = block + int(parts[i]), 0
    return first, parts


def _bounds(x: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest score that an item of each list can have; a zero query has no angle, and scores 0 everywhere."""
    best = np.cos(np.maximum(_angles(x, centres) - radius, 0))
    best[~x.any(1)] = 0.0
    return best


def _listed(rows: DataFrame, centres, kind: str) -> DataFrame:
    """``(id, list, angle, vector)``: each row in the list of its nearest centre, with the angle to it."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                angles = _angles(unit_rows(part.column(1)), centres.value)
                own = angles.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.int32()), pa.array(angles[np.arange(len(own)), own]), part.column(1)], names=["id", "list", "angle", "vector"])

    return rows.mapInArrow(run, f"id long, list int, angle double, vector {kind}")


def _homed(queries: DataFrame, centres, bounds, kind: str) -> DataFrame:
    """``(query_id, vector, home)``: each query with the first block of the list that can hold its best item."""

    def run(batches):
        radius, items, first, _ = bounds.value
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                best = _bounds(unit_rows(part.column(1)), centres.value, radius)
                best[:, items == 0] = -np.inf
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(first[best.argmax(1)])], names=["query_id", "vector", "home"])

    return queries.mapInArrow(run, f"query_id long, vector {kind}, home long")


def _wanted(queries: DataFrame, centres, bounds, kind: str) -> DataFrame:
    """``(query_block, item_block, id, vector, floor)``: queries with each block that has a list whose bound reaches the
    query's ``floor``."""

    def run(batches):
        radius, items, first, parts = bounds.value
        begins = np.flatnonzero(np.append(True, first[1:] != first[:-1]))  # lists come in the order of their blocks
        blocks, times = first[begins], np.maximum.reduceat(parts, begins)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                best = _bounds(unit_rows(part.column(2)), centres.value, radius)
                best[:, items == 0] = -np.inf
                row, at = np.nonzero(np.maximum.reduceat(best, begins, axis=1) >= part.column(3).to_numpy()[:, None] - _SLACK)
                which = np.repeat(row, times[at])
                nth = np.arange(len(which)) - np.repeat(np.cumsum(times[at]) - times[at], times[at])
                block = np.repeat(blocks[at], times[at]) + nth
                for b in range(0, len(which), 16_384):
                    some = pa.array(which[b : b + 16_384])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(some), pa.array(block[b : b + 16_384]), *(part.column(i).take(some) for i in (1, 2, 3))], names=["query_block", "item_block", "id", "vector", "floor"])

    return queries.mapInArrow(run, f"query_block long, item_block long, id long, vector {kind}, floor double")


class _Pair:
    """A block of queries in a task with the items of a block: the best ``k`` of each query so far."""

    def __init__(self, key: tuple[int, int], k: int, exclude_self: bool):
        self.key, self.k, self.own = key, k, exclude_self
        self.parts, self.lists = [], None

    def begin(self, centres, bounds, nearest: bool) -> None:
        """Which lists of the block each query searches: the first ones with enough items, or those that reach its floor."""
        radius, items, first, parts = bounds
        self.ids = np.concatenate([p.column(4).to_numpy() for p in self.parts])
        self.x = np.concatenate([unit_rows(p.column(5)) for p in self.parts])
        self.floor = np.concatenate([p.column(6).to_numpy() for p in self.parts])
        self.score, self.record = np.full((len(self.ids), self.k), -np.inf), np.zeros((len(self.ids), self.k), np.int64)
        own = np.flatnonzero((items > 0) & (first <= self.key[1]) & (self.key[1] < first + parts))
        self.lists, self.want = {x: i for i, x in enumerate(own.tolist())}, np.zeros((len(own), len(self.ids)), bool)
        for a in range(0, len(self.ids), 2048):
            some = slice(a, a + 2048)
            best = _bounds(self.x[some], centres[own], radius[own])
            if nearest:
                order = np.argsort(-best, axis=1, kind="stable")
                enough = np.cumsum(items[own][order], axis=1) - items[own][order] < self.k + self.own
                np.put_along_axis(best, order, enough, 1)
                self.want[:, some] = best.T > 0
            else:
                self.want[:, some] = best.T >= self.floor[some] - _SLACK

    def search(self, of: int, ids: np.ndarray, x: np.ndarray) -> int:
        """Compare items of a list, sorted by id, with the queries that search it; returns the number of pairs."""
        asked = np.flatnonzero(self.want[self.lists[of]])
        for a in range(0, len(asked), 1024):
            rows = asked[a : a + 1024]
            scores = self.x[rows] @ x.T
            if self.own:
                place = np.minimum(np.searchsorted(ids, self.ids[rows]), len(ids) - 1)
                same = np.flatnonzero(ids[place] == self.ids[rows])
                for step in range(len(ids)):  # an id may come more than once
                    at = place[same] + step
                    same = same[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == self.ids[rows[same]])]
                    if not len(same):
                        break
                    scores[same, place[same] + step] = -np.inf
            least = np.maximum(self.floor[rows], self.score[rows, -1])
            if len(ids) > self.k and (open_ := np.flatnonzero(least < -1)).size:  # nothing is known of these yet
                least[open_] = np.partition(scores[open_], -self.k, axis=1)[:, -self.k]
            row, item = np.nonzero((scores >= least[:, None] - _SLACK) & (scores > -np.inf))
            if not len(row):
                continue
            met = np.unique(row)
            owner = np.concatenate((row, np.repeat(met, self.k)))
            score = np.concatenate((np.round(scores[row, item], 9) + 0.0, self.score[rows[met]].ravel()))
            record = np.concatenate((ids[item], self.record[rows[met]].ravel()))
            order = np.lexsort((record, -score, owner))
            begin = np.searchsorted(owner[order], met)
            best = order[begin[:, None] + np.arange(self.k)]
            self.score[rows[met]], self.record[rows[met]] = score[best], record[best]
        return len(asked) * len(ids)


def _searched(rows: DataFrame, centres, bounds, k: int, exclude_self: bool, counted, kind: str, nearest: bool) -> DataFrame:
    """What the pairs of blocks give: with ``nearest`` the queries ``(query_block, query_id, vector, floor)`` with a score that
    their ``k``-th neighbour has at least, else ``(query_id, record_id, score)`` with the best ``k`` of each query and pair.

    ``rows`` are (query_block, item_block, list, side, id, vector, floor), queries (side 0, list -1) and items (side 1).
    """

    def given(pair):
        if pair is None or (pair.lists is None and not nearest):
            return
        if not nearest:
            some = pair.score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(pair.ids, k)[some.ravel()]), pa.array(pair.record[some]), pa.array(pair.score[some])], names=["query_id", "record_id", "score"])
            return
        floor = np.full(sum(p.num_rows for p in pair.parts), -2.0) if pair.lists is None else np.where(pair.score[:, -1] > -np.inf, pair.score[:, -1], -2.0)
        done = 0
        for p in pair.parts:
            yield pa.RecordBatch.from_arrays([p.column(0), p.column(4), p.column(5), pa.array(floor[done : done + p.num_rows])], names=["query_block", "query_id", "vector", "floor"])
            done += p.num_rows

    def run(batches):
        pair = None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)])
            borders = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for a, b in zip([0, *borders.tolist()], [*borders.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                part, key = batch.slice(a, b - a), (int(keys[0, a]), int(keys[1, a]))
                if pair is None or pair.key != key:
                    yield from given(pair)
                    pair = _Pair(key, k, exclude_self)
                if keys[3, a] == 0:  # a pair's queries come before its items
                    pair.parts.append(part)
                elif pair.parts:
                    if pair.lists is None:
                        pair.begin(centres.value, bounds.value, nearest)
                    counted.add(pair.search(int(keys[2, a]), part.column(4).to_numpy(), unit_rows(part.column(5))))
        yield from given(pair)

    out = f"query_block long, query_id long, vector {kind}, floor double" if nearest else "query_id long, record_id long, score double"
    at = ["query_block", "item_block"]
    return rows.repartition(*at).sortWithinPartitions(*at, "list", "id").mapInArrow(run, out)


def nearest(items: DataFrame, queries: DataFrame, k: int = 20, exclude_self: bool = False, lists: int | None = None, counted=None) -> DataFrame:
    """``(query_id, record_id, score)`` with, for each query, its best ``k`` of ``items`` and few others; exact.

    Both have ``(record_id | query_id, vector)``, all vectors of one length without null components. Null vectors of items
    are left out; null vectors of queries, and zero ones of either side, score 0. ``lists`` defaults to the root of the
    number of items. ``counted``, an accumulator, gets the number of pairs that are scored.

    Where the vectors do not cluster every pair is scored: the time grows as the square of the rows, and what is shuffled
    as the rows times the number of blocks.
    """
    spark = items.sparkSession
    counted = counted if counted is not None else spark.sparkContext.accumulator(0)
    kind = "array<float>" if {dict(x.dtypes)["vector"] for x in (items, queries)} == {"array<float>"} else "array<double>"
    held = items.where(F.col("vector").isNotNull()).select(F.col("record_id").cast("long").alias("id"), F.col("vector").cast(kind).alias("vector"))
    n, width = held.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, record_id long, score double")
    lists = min(lists or max(int(np.sqrt(n)), 1), max(CENTRE_BYTES // (8 * width), 1))
    rows = max(min(BLOCK_BYTES // (8 * width), BLOCK_ROWS, max(-(-n // BLOCKS), LEAST_ROWS)), 1)
    sample = held.orderBy(F.xxhash64("id")).limit(SAMPLE).select("vector").toArrow()  # a bound on what the driver gets
    fitted = fitted_centres(unit_rows(sample.column(0).combine_chunks()), lists)
    near = fitted_centres(fitted, -(-n // rows))
    centres = spark.sparkContext.broadcast(fitted[np.argsort((fitted @ near.T).argmax(1), kind="stable")])
    placed = stored(_listed(held, centres, kind), "listed")
    radius, count = np.zeros(len(fitted)), np.zeros(len(fitted), np.int64)
    for row in placed.groupBy("list").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect():  # as many as there are centres
        radius[row["list"]], count[row["list"]] = row["radius"] + 1e-9, row["n"]
    first, parts = _blocks(count, rows)
    bounds = spark.sparkContext.broadcast((radius, count, first, parts))
    blocks = F.broadcast(spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first, parts, strict=True))], "list int, first long, parts long"))
    in_block = placed.join(blocks, "list").select("list", "id", "vector", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("item_block"))
    zero = F.array_repeat(F.lit(0.0), int(width)).cast(kind)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce(F.col("vector").cast(kind), zero).alias("vector"))
    asked = stored(_homed(asked, centres, bounds, kind), "queries")
    homes, at = [], 0
    for home, n_asked in sorted(map(tuple, asked.groupBy("home").count().collect())):  # as many as there are blocks
        homes.append((home, at, -(-n_asked // rows)))
        at += homes[-1][2]
    if not homes:
        return spark.createDataFrame([], "query_id long, record_id long, score double")
    of_home = F.broadcast(spark.createDataFrame(homes, "home long, at long, cuts long"))
    asked = asked.join(of_home, "home").select((F.col("at") + F.pmod(F.xxhash64("query_id"), F.col("cuts"))).alias("query_block"), F.col("home").alias("item_block"), F.col("query_id").alias("id"), "vector", F.lit(-2.0).alias("floor"))

    def together(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        columns = ["query_block", "item_block", "list", "side", "id", "vector", "floor"]
        own = in_block.join(F.broadcast(pairs), "item_block").withColumns({"side": F.lit(1), "floor": F.lit(0.0)})
        return asked.withColumns({"list": F.lit(-1), "side": F.lit(0)}).select(*columns).unionByName(own.select(*columns))

    pairs = spark.createDataFrame([(a + i, h) for h, a, m in homes for i in range(m)], "query_block long, item_block long")
    floors = stored(_searched(together(asked, pairs), centres, bounds, k, exclude_self, counted, kind, True), "floors")
    wanted = _wanted(floors, centres, bounds, kind)
    pairs = stored(wanted.select("query_block", "item_block").distinct(), "pairs")  # of blocks
    return _searched(together(wanted, pairs), centres, bounds, k, exclude_self, counted, kind, False)
