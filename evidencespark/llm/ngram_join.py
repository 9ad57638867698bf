"""N-gram Jaccard join by prefix trees.

Documents whose sets of word n-grams have a Jaccard similarity of ``percent`` / 100 or more are linked. N-grams get
one global order: those that many documents hold come last. A pair that links shares one of the first
``n - ceil(n * percent / 100) + 1`` n-grams of both documents (its prefix), so:

1. One pass over the texts gives each document's set (by 62-bit hashes), a hash of the set, its prefix, and its
   n-grams below a fixed hash (a sample that all sets draw alike). Equal sets are one node from here on.
2. The samples are shuffled: of a set that links, at most ``n - ceil(n * percent / 100)`` n-grams are in no other set.
   Nodes of whose sample more are alone go, among those that are left again. So sets that share a passage only are gone
   before anything is tied, and what is tied does not grow together with the corpus.
   Prefix n-grams of the other nodes are shuffled; those that can link two nodes tie these to candidate components.
3. A component is worked on by classes of set sizes (sets that link are of the same class or of neighbouring ones), a
   class in blocks of bounded size, each pair of blocks in its own task. First this is done with a bitmap of each set
   (the parity of its n-grams by hash, about two bits an n-gram): as many bits as two bitmaps differ in, so many
   n-grams at least are in one of the sets only. Pairs that may link by that bound make smaller components; most
   nodes that share no more than a passage are gone after it.
4. The full sets of the nodes that are left are fetched once. Of each set, the n-grams that others of its component
   hold go, with its size, to the pairs of blocks: the sets of one block form a prefix tree, in which sets with equal
   beginnings share nodes; each set of the other block is carried down the tree with the overlap so far, and a subtree
   is left as soon as its remaining lengths cannot reach the threshold, or when all its documents are connected with
   the set already.
5. Tasks return a spanning forest of the links they find; components of these are the classes.

The order comes from a bounded table of the most frequent n-grams (counted over all documents). Any order gives
the same links: the table only keeps frequent n-grams out of prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.llm.common import free_name, key_runs, list_parts, small_batches, small_side, stored, text_bytes
from evidencespark.llm.components import connected_components

#: Most frequent n-grams with a place of their own at the end of the order.
FREQUENT = 65_536
#: Most nodes, and about the most n-grams, of one block of a component.
BLOCK_NODES, BLOCK_GRAMS = 2048, 1 << 21
#: Holders of a prefix n-gram up to this many are looked at pair by pair; more are tied together as a chain.
PAIRWISE = 1024
#: N-grams with at least this count are dealt out by set size and node as well.
HOT = 4096
#: Parts by node of each class of sizes of a hot n-gram.
HOT_PARTS = 64
#: The share of all hashes below which n-grams are in the sample, and how often the samples are compared.
SAMPLED, ROUNDS = 0.45, 2
#: Most rows of one n-gram that a task holds while it counts who shares n-grams.
HELD_ROWS = 65_536
#: Fewest bits of a bitmap.
LEAST_BITS = 256
RUN_BYTES = 1 << 20

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BASE, _STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_MASK = np.uint64((1 << 62) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of a run of texts (A-Z lower-cased), and the number of words of each text."""
    n = len(offsets) - 1
    low = _LOW[data]
    letter = (low != 32) & ((low < 9) | (low > 13))
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1] | border[1:-1]
    last[:-1] &= ~letter[1:] | border[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    length = end - start
    at = np.flatnonzero(letter)
    place = at - np.repeat(start, length)
    power = np.full(int(length.max()), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.add.reduceat((low[at].astype(np.uint64) + np.uint64(1)) * power[place], np.concatenate(([0], np.cumsum(length)[:-1])))
    counts = np.searchsorted(start, offsets[1:]) - np.searchsorted(start, offsets[:-1])
    return _mix(sums + length.astype(np.uint64) * _STEP), counts


def gram_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text of a run the sorted distinct hashes (62 bits) of its n-grams of ``words`` words.

    A text of fewer words has its whole sequence as its one n-gram; a text without words has none.
    """
    hashes, counts = word_hashes(data, offsets)
    grams = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for i in range(words):
        grams = (grams + hashes[i : i + len(grams)]) * _STEP
    grams = (_mix(grams) & _MASK).astype(np.int64)
    at = 0
    for count in counts:
        if count >= words:
            yield np.unique(grams[at : at + count - words + 1])
        elif count:
            short = np.uint64(count)
            with np.errstate(over="ignore"):
                for h in hashes[at : at + count]:
                    short = (short + h) * _STEP
            yield (_mix(np.array([short ^ np.uint64(1)])) & _MASK).astype(np.int64)
        else:
            yield np.zeros(0, np.int64)
        at += count


def _runs(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = text_bytes(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + RUN_BYTES, side="right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def frequent_grams(docs: DataFrame, words: int, most: int = FREQUENT) -> tuple[np.ndarray, int]:
    """The ``most`` n-grams that most documents hold, from the most frequent down, and how many of them are hot.

    All documents are counted; an n-gram that one slice of a few MB of texts holds once is not counted there.
    """

    def count(batches):
        for batch in batches:
            for data, offsets in _runs(batch.column(0)):
                grams, n = np.unique(np.concatenate([*gram_sets(data, offsets, words), np.zeros(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["gram", "n"])

    counted = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counted.where("n >= 4").orderBy(F.desc("n"), "gram").limit(most).collect()
    return np.array([r["gram"] for r in top], np.int64), sum(r["n"] >= HOT for r in top)


class GramOrder:
    """The global order as numbers: hashes as they are, then the frequent n-grams, the most frequent one last."""

    def __init__(self, frequent: np.ndarray, hot: int):
        self.hot_from = (1 << 62) + len(frequent) - hot
        order = np.argsort(frequent, kind="stable")
        self.grams, self.places = frequent[order], (np.int64(1 << 62) + len(frequent) - 1 - order).astype(np.int64)

    def sample(self, grams: np.ndarray) -> np.ndarray:
        """The n-grams of a set, sorted by hash, that are sampled and not frequent: those are known to be in several sets."""
        grams = grams[: np.searchsorted(grams, int(SAMPLED * (1 << 62)))]
        if not len(self.grams):
            return grams
        return grams[self.grams[np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)] != grams]

    def apply(self, grams: np.ndarray) -> np.ndarray:
        if len(self.grams) and len(grams):
            at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
            grams = np.where(self.grams[at] == grams, self.places[at], grams)
        return np.sort(grams)


def _node(grams: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        total = _mix(grams.astype(np.uint64)).sum(dtype=np.uint64) + np.uint64(len(grams)) * _STEP
    return int(_mix(np.array([total])).astype(np.int64)[0])


def parity_bitmap(grams: np.ndarray) -> np.ndarray:
    """The parities of how many n-grams of a set fall on each of a power of two of bits, at least two bits an n-gram."""
    bits = max(LEAST_BITS, 1 << (2 * len(grams) - 1).bit_length()) if len(grams) else LEAST_BITS
    places = _mix(grams.astype(np.uint64)) & np.uint64(bits - 1)
    odd = np.bincount(places.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    while len(bitmap) > words:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def least_overlap(a, b, percent: int):
    """The smallest intersection of sets of ``a`` and ``b`` elements that links them."""
    return -(-(a + b) * percent // (100 + percent))


def size_class(n: Column, percent: int) -> Column:
    """The class of a set's size: sets that link are of the same class or of neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")


def sets_table(docs: DataFrame, order, words: int, percent: int) -> DataFrame:
    """``(doc_id, digest, node, n, prefix, bits, sample)`` for each row of ``docs``; the digest is that of its text."""

    def lists(parts):
        ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))

    def run(batches):
        for batch in batches:
            done = 0
            for data, offsets in _runs(batch.column(2)):
                nodes, sizes, prefixes, bits, samples = [], [], [], [], []
                for grams in gram_sets(data, offsets, words):
                    n = len(grams)
                    nodes.append(_node(grams))
                    sizes.append(n)
                    bits.append(parity_bitmap(grams).tobytes())
                    prefixes.append(order.value.apply(grams)[: n - -(-n * percent // 100) + 1 if n else 0])
                    samples.append(order.value.sample(grams))
                own = [batch.column(i).slice(done, len(sizes)) for i in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), lists(prefixes), pa.array(bits, pa.binary()), lists(samples)],
                    names=["doc_id", "digest", "node", "n", "prefix", "bits", "sample"],
                )
                done += len(sizes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, digest binary, node long, n long, prefix array<long>, bits binary, sample array<long>")


def text_digest(text: Column) -> Column:
    """128 bits that tell apart the texts of rows that share an id; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _shared(gram: np.ndarray, node: np.ndarray, done: int = 0) -> np.ndarray:
    """The nodes of those n-grams that two or more nodes have; rows are sorted, the first ``done`` are not asked for."""
    new = gram[1:] != gram[:-1]
    fresh = np.append(True, new | (node[1:] != node[:-1]))[: len(gram)]  # rows of equal sets count once
    group = np.cumsum(np.append(True, new))[: len(gram)] - 1
    found = fresh & (np.bincount(group, weights=fresh) > 1)[group] if len(gram) else fresh
    found[:done] = False
    return node[found]


def shared_counts(rows: DataFrame) -> DataFrame:
    """``(node, shared)``: how many n-grams of each node in ``rows(gram, node)`` another node has as well."""

    def given(nodes):
        names, times = np.unique(nodes, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(times, pa.int64())], names=["node", "shared"])

    def count(batches):
        gram, node, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # rows of the last n-gram; of these are counted
        for batch in batches:
            gram, node = (np.concatenate((x, batch.column(c).to_numpy())) for x, c in ((gram, "gram"), (node, "node")))
            if not len(gram):
                continue
            begin = int(np.searchsorted(gram, gram[-1]))  # the last group may go on in the next batch
            yield given(_shared(gram[:begin], node[:begin], done))
            done = done if begin == 0 else 0
            gram, node = gram[begin:], node[begin:]
            if len(gram) > HELD_ROWS:  # a large group: two rows are enough of what is counted
                before = node != node[-1]
                if before.any():
                    yield given(np.unique(node[before][done:]))
                    gram, node, done = gram[[0, -1]], node[[0, -1]], 1
                else:
                    gram, node = gram[-1:], node[-1:]
        yield given(_shared(gram, node, done))

    found = rows.select("gram", "node").repartition("gram").sortWithinPartitions("gram", "node").mapInArrow(count, "node long, shared long")
    return found.groupBy("node").agg(F.sum("shared").alias("shared"))


def linkable(sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``sets`` without those of nodes that cannot link, by the n-grams of their samples that no other has."""
    for _ in range(ROUNDS):
        sampled = sets.where("n > 0").select("node", F.explode("sample").alias("gram"))
        sizes = sets.where("n > 0").groupBy("node").agg(F.max("n").alias("n"), F.max(F.size("sample")).alias("sampled"))
        left = sizes.join(shared_counts(sampled), "node", "left")
        alone = F.col("sampled") - F.coalesce("shared", F.lit(0))
        left = stored(left.where(alone <= F.col("n") - F.ceil(F.col("n") * percent / 100)).select("node"), "linkable")
        sets = sets.join(small_side(left, 1_000_000), "node")
    return sets


def _tied(gram, part, n, node, pos, percent: int, hot_from: int, pairwise: int, chained: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ties between the holders of whole groups of rows, sorted by n-gram, part, set size and node."""
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])
    fresh = new.copy()
    fresh[1:] |= node[1:] != node[:-1]  # rows of equal sets count once
    gram, n, node, pos, new = gram[fresh], n[fresh], node[fresh], pos[fresh], new[fresh]
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)[group]
    chain = (gram >= hot_from) | (sizes > pairwise)
    if chained and len(chain):
        chain |= group == 0
    a, b = [], []
    for d in range(1, max(pairwise, 2)):
        i = np.flatnonzero(group[d:] == group[:-d]) if d < len(group) else np.zeros(0, np.int64)
        if not len(i):
            break
        j = i + d
        fits = n[i] * 100 >= percent * n[j]  # sets come by size: beyond a gap no pair can link
        reach = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least_overlap(n[i], n[j], percent)
        keep = fits & np.where(chain[i], d == 1, reach)
        a.append(node[i[keep]])
        b.append(node[j[keep]])
    return _forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties of each node with one node of its component: they connect what ``(a, b)`` connect."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)  # roots hook to smaller roots
        while (further := label[label]).tobytes() != label.tobytes():
            label = further
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def candidate_components(sets: DataFrame, order, percent: int) -> DataFrame:
    """``(node, component)`` of the nodes that are tied, directly or not, by n-grams their prefixes share.

    Two holders of an n-gram are tied if, by its place in both sets and their sizes, they can link. Where the
    holders are many, they form a chain by size instead, cut where sizes jump too far to link. Hot n-grams are
    dealt out by class of sizes and by node; sets of one class are never too far apart, so each class of an n-gram
    is tied whole through the first nodes of its parts, and to the class above it where the chain would go on.
    """
    hot_from, pairwise = order.value.hot_from, PAIRWISE
    rows = sets.where("n > 0").select(F.posexplode("prefix").alias("pos", "gram"), "n", "node")
    spread = size_class(F.col("n"), percent) * HOT_PARTS + F.pmod(F.xxhash64("node"), F.lit(HOT_PARTS)).cast("int")
    rows = rows.withColumn("part", F.when(F.col("gram") >= hot_from, spread).otherwise(0).cast("int"))
    names = ["gram", "part", "n", "node", "pos"]

    def tie(batches):
        carry, chained = None, False
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in names]
            if not len(new[0]):
                continue
            whole = [np.concatenate(x) for x in zip(carry, new, strict=True)] if carry else new
            last = len(whole[0]) - 1
            same = (whole[0] == whole[0][last]) & (whole[1] == whole[1][last])
            begin = int(np.argmax(same))  # the last group may go on in the next batch
            a, b = _tied(*[x[:begin] for x in whole], percent, hot_from, pairwise, chained)
            chained = chained and begin == 0
            carry = [x[begin:] for x in whole]
            if len(carry[0]) > 16 * pairwise:  # a large group: a chain in any case, so its last row is enough
                c, d = _tied(*carry, percent, hot_from, pairwise, True)
                a, b = np.concatenate((a, c)), np.concatenate((b, d))
                carry, chained = [x[-1:] for x in carry], True
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if carry:
            a, b = _tied(*carry, percent, hot_from, pairwise, chained)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    ties = rows.select(*names).repartition("gram", "part").sortWithinPartitions(*names[:4]).mapInArrow(tie, "a long, b long")
    heads = rows.where(F.col("gram") >= hot_from).groupBy("gram", "part").agg(F.min("node").alias("node"), F.min("n").alias("least"), F.max("n").alias("most"))
    heads = heads.withColumn("cls", F.floor(F.col("part") / HOT_PARTS).cast("int"))
    own, by = W.partitionBy("gram", "cls"), W.partitionBy("gram").orderBy("cls", "part")
    heads = heads.withColumns({"least": F.min("least").over(own), "most": F.max("most").over(own)})
    heads = heads.select("node", "cls", "least", *[F.lag(c).over(by).alias(f"_{c}") for c in ("node", "cls", "most")])
    goes_on = (F.col("cls") == F.col("_cls")) | (F.col("_most") * 100 >= F.col("least") * percent)
    between = heads.where(goes_on & (F.col("node") != F.col("_node")))
    return connected_components(ties.unionByName(between.select(F.col("node").alias("a"), F.col("_node").alias("b"))))


class PrefixTree:
    """Ordered sets as a path-compressed trie. Its nodes are numbered level by level, children after parents.

    For each node: its parent, the range of sorted sets below it, how many n-grams lead to it, and the least and
    largest size of those sets. ``tokens`` holds the sets one after another; a node's own n-grams are those of its
    first set between its parent's depth and its own. ``sizes`` are the sizes of the whole sets, of which the tree
    may hold only the n-grams that other sets have as well.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        sets = [sets[i] for i in self.order]
        self.sizes = sizes[self.order]
        lengths = np.array([len(x) for x in sets])
        self.tokens = np.concatenate(sets)
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        common = [0]
        for a, b in zip(sets[:-1], sets[1:], strict=True):
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            common.append(int(differ[0]) if len(differ) else k)
        # Nodes as (depth, first set, end of sets, parent), made from the common lengths of neighbours by a stack.
        root = [0, 0, len(sets), None, 0]
        made, stack = [root], [root]
        for i, (lcp, size) in enumerate(zip(common, lengths.tolist(), strict=True)):
            last = None
            while stack[-1][0] > lcp or (stack[-1][4] and stack[-1][0] == lcp):  # leaves have no children
                last = stack.pop()
                last[2] = i
            if stack[-1][0] < lcp:
                inner = [lcp, last[1], len(sets), stack[-1], 0]
                last[3] = inner
                made.append(inner)
                stack.append(inner)
            leaf = [size, i, i + 1, stack[-1], 1]
            made.append(leaf)
            if size > lcp:
                stack.append(leaf)
        level = {id(root): 0}

        def depth_of(x):
            path = []
            while id(x) not in level:
                path.append(x)
                x = x[3]
            at = level[id(x)]
            for y in reversed(path):
                at += 1
                level[id(y)] = at
            return at

        for x in made:
            depth_of(x)
        made.sort(key=lambda x: level[id(x)])
        number = {id(x): k for k, x in enumerate(made)}
        self.levels = np.searchsorted([level[id(x)] for x in made], np.arange(level[id(made[-1])] + 2))
        self.depth = np.array([x[0] for x in made])
        self.first = np.array([x[1] for x in made])
        self.end = np.array([x[2] for x in made])
        self.parent = np.array([number[id(x[3])] if x[3] is not None else 0 for x in made])
        self.leaf = np.array([x[4] for x in made], bool)
        self.least = np.array([self.sizes[x[1] : x[2]].min() for x in made])
        self.most = np.array([self.sizes[x[1] : x[2]].max() for x in made])
        self.longest = np.array([lengths[x[1] : x[2]].max() for x in made])

    def matches(self, grams: np.ndarray, size: int, member: np.ndarray, wanted: np.ndarray, percent: int) -> np.ndarray:
        """Positions (in sorted order) of the wanted sets that link with a set of ``size``; ``member`` marks ``grams``."""
        open_sets = np.concatenate(([0], np.cumsum(wanted)))
        overlap = np.zeros(len(self.depth), np.int64)
        alive = np.zeros(len(self.depth), bool)
        alive[0] = True
        found = []
        for a, b in zip(self.levels[1:-1], self.levels[2:], strict=True):
            at = np.arange(a, b)
            at = at[alive[self.parent[at]]]
            at = at[open_sets[self.end[at]] > open_sets[self.first[at]]]
            at = at[(self.most[at] * 100 >= percent * size) & (self.least[at] * percent <= 100 * size)]
            if not len(at):
                break
            above = self.depth[self.parent[at]]
            length = self.depth[at] - above
            begin = self.starts[self.first[at]] + above
            ends = np.cumsum(length)
            where = np.arange(ends[-1]) + np.repeat(begin - (ends - length), length)
            sums = np.concatenate(([0], np.cumsum(member[self.tokens[where]])))
            overlap[at] = overlap[self.parent[at]] + sums[ends] - sums[ends - length]
            last = self.tokens[self.starts[self.first[at]] + np.maximum(self.depth[at] - 1, 0)]
            mine = len(grams) - np.searchsorted(grams, last, side="right")
            reach = overlap[at] + np.minimum(mine, self.longest[at] - self.depth[at])
            need = least_overlap(size, np.maximum(self.least[at], self.depth[at]), percent)
            leaf = self.leaf[at]
            alive[at] = ~leaf & (reach >= need)
            done = at[leaf]
            hit = overlap[done] >= least_overlap(size, self.sizes[self.first[done]], percent)
            found.append(self.first[done[hit]])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def link_forest(nodes: list[int], sets: list[np.ndarray], sizes: list[int], side: list[int], percent: int, within: bool = True) -> list[tuple[int, int]]:
    """Links between ``nodes`` that connect all of them that links connect.

    Looked at are the pairs of side 0, which forms the tree (if ``within``), and those of a node of side 0 and one
    of side 1. Pairs that the links so far connect are passed over.
    """
    tree_of = [i for i, s in enumerate(side) if s == 0]
    others = [i for i, s in enumerate(side) if s == 1]
    if not tree_of:
        return []
    known = np.unique(np.concatenate(sets))
    ranks = [np.searchsorted(known, x).astype(np.int32) for x in sets]
    n_known = len(known)
    del known
    tree = PrefixTree([ranks[i] for i in tree_of], np.array([sizes[i] for i in tree_of]))
    sorted_nodes = np.array([tree_of[k] for k in tree.order])
    label = np.arange(len(nodes))
    member = np.zeros(n_known + 1, bool)
    out = []
    asking = [(q, place + 1) for place, q in enumerate(sorted_nodes.tolist())] if within else []
    for q, since in asking + [(q, 0) for q in others]:
        wanted = label[sorted_nodes] != label[q]
        wanted[:since] = False
        if not wanted.any():
            continue
        member[ranks[q]] = True
        for k in tree.matches(ranks[q], sizes[q], member, wanted, percent):
            d = int(sorted_nodes[k])
            if label[d] != label[q]:
                out.append((nodes[q], nodes[d]))
                label[label == label[d]] = label[q]
        member[ranks[q]] = False
    return out


def near_forest(nodes: list[int], bitmaps: list[np.ndarray], sizes: list[int], side: list[int], percent: int, within: bool = True) -> list[tuple[int, int]]:
    """As :func:`link_forest`, of the pairs that may link by their bitmaps and sizes: all that link are among them."""
    words = min(len(x) for x in bitmaps)
    maps, size = np.stack([folded(x, words) for x in bitmaps]), np.array(sizes)
    ones = np.flatnonzero(np.array(side) == 0)
    others = np.flatnonzero(np.array(side) == 1)
    label = np.arange(len(nodes))
    out = []
    asking = [(q, place + 1) for place, q in enumerate(ones.tolist())] if within else []
    for q, since in asking + [(q, 0) for q in others.tolist()]:
        at = ones[since:]
        at = at[(label[at] != label[q]) & (size[at] * 100 >= percent * size[q]) & (size[at] * percent <= 100 * size[q])]
        if not len(at):
            continue
        differ = np.bitwise_count(maps[at] ^ maps[q]).sum(axis=1, dtype=np.int64)
        at = at[differ <= size[at] + size[q] - 2 * least_overlap(size[at], size[q], percent)]
        found, first = np.unique(label[at], return_index=True)
        if len(found):
            out.extend((nodes[q], nodes[d]) for d in at[first].tolist())
            label[np.isin(label, found)] = label[q]
    return out


def with_blocks(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (component, node, n, ...) with their class of sizes ``cls`` and ``blocks``: how many blocks the class
    below, the own one and the one above have in the component. Sets that link are of the same or of neighbouring classes.
    """
    members = members.withColumn("cls", size_class(F.col("n"), percent))
    sizes = members.groupBy("component", "cls").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("grams") / BLOCK_GRAMS))
    sizes = sizes.select(F.col("component").alias("_component"), "cls", F.least(blocks, F.col("members")).cast("int").alias("blocks"))
    sizes = sizes.groupBy("_component").agg(F.map_from_entries(F.collect_list(F.struct("cls", "blocks"))).alias("blocks"))
    members = members.join(stored(sizes, "component-sizes"), F.col("component") == F.col("_component")).drop("_component")
    of = lambda step: F.coalesce(F.try_element_at("blocks", F.col("cls") + step), F.lit(0))
    return members.withColumn("blocks", F.array(of(-1), of(0), of(1)))


def block_pairs(members: DataFrame, content: str, forest, percent: int) -> DataFrame:
    """``(a, b)``: what ``forest`` finds in the pairs of blocks; ``members`` has ``cls`` and ``blocks``, and ``content``.

    A block meets the other blocks of its class, and those of the class above: with the first of these (or alone,
    if there is none) its own pairs are looked at as well.
    """
    below, same, above = (F.col("blocks")[i] for i in range(3))
    own = F.pmod(F.xxhash64("node"), same).cast("int")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def task(cls, up, left, right, side):
        return F.struct(cls.alias("cls"), F.lit(up).alias("up"), left.alias("left"), right.alias("right"), side.alias("side"))

    cls, mine, zero, one = F.col("cls"), F.col("own"), F.lit(0), F.lit(1)
    tasks = F.concat(
        F.transform(upto(above), lambda j: task(cls, 1, mine, j, zero)),
        F.when(above == 0, F.array(task(cls, 0, mine, mine, zero))).otherwise(F.filter(F.array(task(cls, 0, mine, mine, zero)), lambda _: F.lit(False))),
        F.transform(
            F.filter(upto(same), lambda o: o != mine),
            lambda o: task(cls, 0, F.least(o, mine), F.greatest(o, mine), F.when(mine > o, one).otherwise(zero)),
        ),
        F.transform(upto(below), lambda i: task(cls - 1, 1, i, mine, one)),
    )
    placed = members.withColumn("own", own).select("component", "node", "n", content, F.explode(tasks).alias("t"))
    placed = placed.select("component", "t.cls", "t.up", "t.left", "t.right", "t.side", "node", "n", content)

    def join(batches):
        for run in key_runs(batches, 5):
            nodes, first = np.unique(run.column("node").to_numpy(), return_index=True)
            up, left, right = (run.column(i)[0].as_py() for i in (2, 3, 4))
            within = right == 0 if up else left == right
            if pa.types.is_list(run.schema.field(8).type):
                values, ends = list_parts(run.column(8))
                held = [values[ends[i] : ends[i + 1]] for i in first.tolist()]
            else:
                held = [np.frombuffer(run.column(8)[i].as_buffer(), np.uint64) for i in first.tolist()]
            sizes, sides = (run.column(c).to_numpy()[first].tolist() for c in ("n", "side"))
            found = forest(nodes.tolist(), held, sizes, sides, percent, within)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    keys = ["component", "cls", "up", "left", "right"]
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(join, "a long, b long")


def similarity_links(docs: DataFrame, sets: DataFrame, order, words: int, percent: int) -> DataFrame:
    """``(a, b)``: links between nodes, enough of them to connect all that links connect."""
    sets = linkable(sets, percent)
    tied = candidate_components(sets, order, percent)
    reps = sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    members = stored(tied.join(reps, "node"), "members")

    closer = connected_components(block_pairs(with_blocks(members, percent), "bits", near_forest, percent))
    members = stored(members.select("node", "doc_id", "n").join(closer, "node"), "near-members")
    members = with_blocks(members, percent).select(F.col("doc_id").alias("rep"), F.col("node").alias("rep_node"), "component", "cls", "blocks")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(small_side(stored(members, "wanted"), 1_000_000), F.col("doc_id").eqNullSafe(F.col("rep")))

    def fetch(batches):
        for batch in batches:
            done = 0
            for data, offsets in _runs(batch.column("text")):
                grams = list(gram_sets(data, offsets, words))
                own = batch.slice(done, len(grams))
                done += len(grams)
                right = np.array([_node(g) for g in grams], np.int64) == own.column("rep_node").to_numpy()
                ordered = [order.value.apply(g) for g in grams]
                ends = np.concatenate(([0], np.cumsum([len(g) for g in ordered]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ordered, np.zeros(0, np.int64)])))
                rows = [own.column("component"), own.column("cls"), own.column("blocks"), own.column("rep_node"), lists]
                yield pa.RecordBatch.from_arrays(rows, names=["component", "cls", "blocks", "node", "grams"]).filter(pa.array(right))

    fetched = texts.select("text", "component", "cls", "blocks", "rep_node")
    fetched = fetched.mapInArrow(fetch, "component long, cls int, blocks array<int>, node long, grams array<long>")
    # N-grams of one set of the component only cannot overlap: of these, the set's size is all that matters.
    size = F.size("grams").alias("n")
    each = fetched.select("component", "cls", "blocks", "node", size, F.explode("grams").alias("gram"))
    holders = W.partitionBy("component", "gram").orderBy("node")
    each = each.withColumns({"before": F.lag("node").over(holders), "after": F.lead("node").over(holders)})
    each = each.where("before <> node OR after <> node")
    fetched = each.groupBy("component", "node").agg(
        F.first("cls").alias("cls"), F.first("blocks").alias("blocks"), F.first("n").alias("n"), F.sort_array(F.collect_set("gram")).alias("grams")
    )
    return block_pairs(fetched, "grams", link_forest, percent)


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``(doc_id, digest, n, component)`` of each row: rows of one component, other than empty sets, are one class."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(GramOrder(*frequent_grams(docs, words)))
    sets = stored(sets_table(docs, order, words, percent), "gram-sets")
    links = similarity_links(docs, sets, order, words, percent)
    with small_batches(spark):  # its rows hold whole sets
        links = stored(links, "links")
    found = connected_components(links)
    each = sets.select("doc_id", "digest", "node", "n").join(found, "node", "left")
    return stored(each.select("doc_id", "digest", "n", F.coalesce("component", "node").alias("component")), "labelled")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row for each row of ``docs(doc_id, text)``.

    ``n_shingles`` is the size of the document's set, ``component_id`` the smallest ``doc_id`` that links lead to,
    its own included. Null texts and texts without words have empty sets, which link with nothing; a text of fewer
    than ``words`` words has its whole sequence as its one n-gram. Rows with equal sets are linked, repeated rows
    and rows that share an id included; null ids take part, and are the ``component_id`` only of components
    without any other id. Other columns are ignored; an empty table gives an empty result.
    """
    each = _classes(docs, words, percent)
    least = each.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    least = stored(least.where("rows > 1").select(F.col("component").alias("_component"), "least"), "component-ids")
    joined = each.join(least, (F.col("component") == F.col("_component")) & (F.col("n") > 0), "left")
    component_id = F.when(F.col("_component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each class of :func:`jaccard_components`: that of the smallest id, null ids last.

    Decided by row: of rows that share an id the one with the smaller digest stays, of repeated rows one. Rows
    without words (null and empty texts) link with nothing and stay. All columns stay, whatever their names; an
    empty table stays empty.
    """
    own_id, own_digest = free_name(docs, "row_id"), free_name(docs, "row_digest")
    each = _classes(docs, words, percent).where("n > 0").select("doc_id", "digest", "component")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    kept = each.groupBy("component").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    kept = stored(kept.select("component", F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest")), "kept-rows")
    each = each.join(kept, "component")
    stays = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest"))
    marked = each.select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest), stays.alias("stays"))
    marked = stored(marked.groupBy(own_id, own_digest).agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("rows")), "marked-rows")
    dropped, repeated = marked.where("NOT stays"), marked.where("stays AND rows > 1")
    keyed = docs.withColumns({f"{own_id}_": F.col("doc_id").cast("long"), f"{own_digest}_": text_digest(F.col("text"))})
    same = F.col(f"{own_id}_").eqNullSafe(F.col(own_id)) & (F.col(f"{own_digest}_") == F.col(own_digest))
    rest = keyed.join(small_side(dropped.select(own_id, own_digest), 500_000), same, "left_anti")
    if not repeated.isEmpty():
        repeated = small_side(repeated.select(own_id, own_digest), 500_000)
        once = rest.join(repeated, same, "left_semi").dropDuplicates([f"{own_id}_", f"{own_digest}_"])
        rest = rest.join(repeated, same, "left_anti").unionByName(once)
    return rest.select(*[F.col(f"`{c}`") for c in docs.columns])
