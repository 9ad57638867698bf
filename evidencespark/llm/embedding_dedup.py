"""Embedding near-dedup by product quantisation.

1. Equal vectors of a label become one node with a count.
2. A coarse quantiser (k-means) and, for the residuals, one codebook for each of ``SUBSPACES`` groups of
   dimensions are fitted on a bounded sample of unit vectors. Every node is indexed: its nearest centroid is its
   list, its residual is stored as codes, with the length of what the codes miss.
3. Every node is also a query. It probes each list in which a vector within the threshold's distance can lie: the
   lists whose border with its own list is no farther off than that. So the probes lose no pair.
4. Within a list (and label), distances from queries to codes are sums of table entries. Pairs whose distance
   exceeds the threshold's by more than the missed length cannot link; all others are compared by their exact
   cosine in double precision. That filter loses no pair either.
5. Tasks return link counts, and a spanning forest of the links; components of the forest are the classes.

Lists are worked on in blocks of bounded size, each pair of blocks (vectors and queries) in its own task. Vectors of
different lengths never meet, as if the length were part of the label; the quantisers see each unit vector by its
first ``dims`` components (zeros beyond its end), which brings vectors no farther apart, so the bounds hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencespark.llm.common import key_runs, list_parts, stored
from evidencespark.llm.components import connected_components

#: Most vectors the quantisers are fitted on, and most inverted lists; there are half as many as the root of the vectors.
SAMPLE, LISTS = 32_768, 2048
SUBSPACES, CODES = 8, 64
#: Most vectors, and most queries, in one task's block of a list.
BLOCK = 1024


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray  # lists x dimensions
    codebooks: list  # for each subspace, codes x its dimensions
    cuts: np.ndarray  # where the subspaces begin and end

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest list of each vector, and its squared distances to all centroids."""
        far = (x**2).sum(1)[:, None] + (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return far.argmin(1), far

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of residuals, and the length of what they miss."""
        out, missed = np.zeros((len(residual), len(self.codebooks)), np.uint8), np.zeros(len(residual))
        for i, book in enumerate(self.codebooks):
            part = residual[:, self.cuts[i] : self.cuts[i + 1]]
            far = (part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T
            out[:, i] = far.argmin(1)
            missed += ((part - book[out[:, i]]) ** 2).sum(1)
        return out, np.sqrt(missed)

    def probes(self, far: np.ndarray, own: np.ndarray, radius: float) -> np.ndarray:
        """Which lists can hold a vector within ``radius``: by the distance to the border between two lists."""
        length, mine = (self.centroids**2).sum(1), self.centroids[own]
        gap = np.sqrt(np.maximum(length[own][:, None] + length - 2 * mine @ self.centroids.T, 1e-18))
        border = (far - np.take_along_axis(far, own[:, None], 1)) / (2 * gap)
        border[np.arange(len(own)), own] = 0
        return border <= radius + 1e-9


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster takes the vector that is farthest from its centroid."""
    k = max(1, min(k, len(x)))
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        far = (x**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * x @ centroids.T
        own = far.argmin(1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centroids[empty] = x[np.argsort(-far.min(1))[: len(empty)]]
    return centroids


def fit_quantiser(sample: np.ndarray, n_lists: int) -> Quantiser:
    centroids = k_means(sample, n_lists, 8, 3)
    far = (centroids**2).sum(1) - 2 * sample @ centroids.T
    residual = sample - centroids[far.argmin(1)]
    dims = sample.shape[1]
    cuts = np.linspace(0, dims, min(SUBSPACES, dims) + 1).astype(int)
    books = [k_means(residual[:, a:b], CODES, 6, 5 + a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return Quantiser(centroids, books, cuts)


def _units(column, dims: int) -> np.ndarray:
    """The first ``dims`` components of each vector, scaled to length 1, with zeros beyond its end."""
    values, offsets = list_parts(column)
    size = np.diff(offsets)
    length = np.sqrt(np.add.reduceat(values * values, offsets[:-1])) if len(size) else np.zeros(0)
    if (size == dims).all():
        return values.reshape(-1, dims) / length[:, None]
    out = np.zeros((len(size), dims))
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(values)) - np.repeat(offsets[:-1], size)
    inside = place < dims
    out[row[inside], place[inside]] = values[inside]
    return out / length[:, None]


def block_links(quantiser: Quantiser, at: int, base: tuple, queries: tuple, threshold: float) -> tuple[np.ndarray, list]:
    """Weighted link counts of a block's queries, and links that connect all that its links connect.

    ``base`` is ``(nodes, vectors, codes, missed, times)``, ``queries`` is ``(nodes, vectors, unit vectors as the
    quantiser sees them)``; ``at`` the list.
    """
    nodes, x, codes, missed, times = base
    q_nodes, q, unit = queries
    residual = unit - quantiser.centroids[at]
    far = np.zeros((len(q), len(x)))
    for i, book in enumerate(quantiser.codebooks):
        part = residual[:, quantiser.cuts[i] : quantiser.cuts[i + 1]]
        look_up = (part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T
        far += look_up[:, codes[:, i]]
    near = np.sqrt(np.maximum(far, 0)) <= np.sqrt(2 - 2 * threshold) + missed[None, :] + 1e-6
    near &= q_nodes[:, None] != nodes[None, :]
    a, b = np.nonzero(near)
    counts, links = np.zeros(len(q), np.int64), []
    length, q_length = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
    label = {}

    def find(n):
        while label.get(n, n) != n:
            label[n] = label.get(label[n], label[n])
            n = label[n]
        return n

    for s in range(0, len(a), 1 << 16):
        i, j = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
        hit = np.einsum("ij,ij->i", q[i], x[j]) / (q_length[i] * length[j]) >= threshold
        i, j = i[hit], j[hit]
        np.add.at(counts, i, times[j])
        for u, v in zip(q_nodes[i].tolist(), nodes[j].tolist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                label[u] = v
                links.append((u, v))
    return counts, links


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``embeddings(vec_id, embedding, label)``.

    Vectors of one label and one length link if their cosine is at least ``threshold``. Vectors that are null, zero or
    hold null or non-finite components link with nothing, nor do those without label. ``n_links`` counts the other
    rows linked directly, equal vectors included; ``component_id`` is the smallest ``vec_id`` that links lead to;
    ``kept`` marks the row that has it. Null ids take part; repeated rows are rows of their own. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    e = e.withColumn("ok", F.coalesce(usable, F.lit(False)))
    # Zeros are one zero: equal vectors have equal digests. The length goes with the label.
    e = e.withColumns({"v": F.transform("v", lambda x: x + F.lit(0.0)), "label": F.concat_ws(":", F.size("v").cast("string"), "label")})
    keys = ["h1", "h2", "label"]
    e = e.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    nodes = e.where("ok").groupBy(*keys).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("times"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    count = nodes.count()
    if count:
        dims = nodes.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()["dims"]
        sample = nodes.orderBy(F.xxhash64(*keys), *keys[:2]).limit(SAMPLE).select("v").toArrow()
        n_lists = int(min(LISTS, max(8, np.sqrt(count) / 2)))
        shared = spark.sparkContext.broadcast(fit_quantiser(_units(sample.column("v"), dims)[: 16 * max(n_lists, 512)], n_lists))
        links = stored(_links(nodes, shared, dims, threshold), "vector-links")
    else:
        links = spark.createDataFrame([], "node long, n long, other long")
    counts = links.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("n"))
    found = connected_components(links.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    each = nodes.select(*keys, "node", "times").join(counts, "node", "left").join(found, "node", "left")
    each = each.select(*keys, F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"))
    each = stored(each, "labelled-vectors")
    rows = e.where("ok").select("vec_id", *keys).join(each, keys).select("vec_id", "component", "n")
    rows = stored(rows, "vector-rows")
    least = rows.groupBy("component").agg(F.min("vec_id").alias("least"))
    least = stored(least.select(F.col("component").alias("_component"), "least"), "least-ids")
    rows = rows.join(least, F.col("component") == F.col("_component")).select("vec_id", F.col("n").alias("n_links"), F.col("least").alias("component_id"))
    alone = e.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(nodes: DataFrame, shared, dims: int, threshold: float) -> DataFrame:
    """``(node, n, other)``: link counts where ``other`` is null, else links."""
    radius = float(np.sqrt(2 - 2 * threshold))

    def index(batches):
        quantiser = shared.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                unit = _units(part.column("v"), dims)
                own, far = quantiser.lists(unit)
                codes, missed = quantiser.codes(unit - quantiser.centroids[own])
                row, probed = np.nonzero(quantiser.probes(far, own, radius))
                ends = np.searchsorted(row, np.arange(len(unit) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("label"), part.column("v"), part.column("times"), pa.array(own, pa.int32())]
                    + [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)]
                    + [pa.ListArray.from_arrays(pa.array(ends), pa.array(probed, pa.int32()))],
                    names=["node", "label", "v", "times", "own", "codes", "missed", "probes"],
                )

    schema = "node long, label string, v array<double>, times long, own int, codes binary, missed double, probes array<int>"
    indexed = stored(nodes.select("node", "label", "v", "times").mapInArrow(index, schema), "vector-index")
    queries = indexed.select("node", "label", "v", F.explode("probes").alias("own"))
    base_size = indexed.groupBy("label", "own").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("base_blocks"))
    query_size = queries.groupBy("label", "own").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("query_blocks"))
    sizes = stored(base_size.join(query_size, ["label", "own"]), "list-sizes")
    spread = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
    base = indexed.join(sizes, ["label", "own"]).withColumns(
        {"base": (spread % F.col("base_blocks")).cast("int"), "query": F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)), "side": F.lit(0)}
    )
    queries = queries.join(sizes, ["label", "own"]).withColumns(
        {"query": (spread % F.col("query_blocks")).cast("int"), "base": F.explode(F.sequence(F.lit(0), F.col("base_blocks") - 1)), "side": F.lit(1)}
    )
    keys = ["label", "own", "base", "query"]
    placed = base.select(*keys, "side", "node", "v", "times", "codes", "missed").unionByName(queries.select(*keys, "side", "node", "v"), allowMissingColumns=True)

    def join(batches):
        quantiser = shared.value
        for run in key_runs(batches, 4):
            side = run.column("side").to_numpy()
            own, asking = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(own) or not len(asking):
                continue
            node, unit = run.column("node").to_numpy(), _units(run.column("v"), dims)
            values, _ = list_parts(run.column("v"))
            x = values.reshape(len(node), -1)  # of one length, as of one label
            held = run.take(own)
            codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), np.uint8).reshape(len(own), -1)
            base = (node[own], x[own], codes, held.column("missed").to_numpy(), held.column("times").to_numpy())
            counts, links = block_links(quantiser, run.column("own")[0].as_py(), base, (node[asking], x[asking], unit[asking]), threshold)
            some = np.flatnonzero(counts)
            a = node[asking[some]].tolist() + [u for u, _ in links]
            n = counts[some].tolist() + [0] * len(links)
            b = [None] * len(some) + [v for _, v in links]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64())], names=["node", "n", "other"])

    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, "node long, n long, other long")
