"""Token ids in files of bit-plane or byte-plane blocks.

Ids stand one after another in the order of ``doc_id`` and are cut into blocks of a fixed number of ids. A block is
transposed into planes (all lowest bytes or bits, then all second ones, up to the highest that is used), each plane is
compressed with zstandard by itself, and a row of the file holds its planes beside its part of the index: shard, block,
how many ids come before it, how many it has, their CRC, and which documents it holds a part of.

Spark's own writer makes and commits the files, so they can lie in any store, and a lost executor leaves no half file: a
shard is a partition of the ordered documents, written as one uncompressed Parquet file whose row groups carry the
smallest and largest place, and a reader of some ids opens only the blocks that hold them. ``shards`` beside them says
how many ids the shards before each have; it is written last, and only files with it are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencespark.llm.word_bpe import WordBpe

#: Ids of a block; each of its documents has one at least, so its part of the index is bounded, too.
BLOCK_IDS = 65_536
#: About the bytes of texts that a task encodes together.
SLICE_BYTES = 1 << 24
LEVEL = 3

BLOCKS = "shard int, block int, first long, n_ids int, bits int, planes array<binary>, ids_crc32 long, docs array<struct<doc_id:bigint,at:bigint,n:bigint>>"
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64())]))
_SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("bits", pa.int32()), ("planes", pa.list_(pa.binary())), ("ids_crc32", pa.int64()), ("docs", _DOCS)])


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of uint32 ``ids``, lowest first: bytes (``bits`` 8) or single bits (1), none of them if all ids are 0."""
    used = int(ids.max()).bit_length() if len(ids) else 0
    if bits == 8:
        rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [np.ascontiguousarray(rows[:, i]).tobytes() for i in range(-(-used // 8))]
    return [np.packbits((ids >> i) & 1).tobytes() for i in range(used)]


def from_planes(planes: list[bytes], bits: int, n: int) -> np.ndarray:
    """The uint32 ids of :func:`to_planes`."""
    ids = np.zeros(n, np.uint32)
    for i, plane in enumerate(planes):
        part = np.frombuffer(plane, np.uint8)
        part = part if bits == 8 else np.unpackbits(part, count=n)
        ids |= part.astype(np.uint32) << np.uint32(i * bits)
    return ids


def _crc(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())


class _Blocks:
    """The ids of a shard as they come, given out as rows of blocks."""

    def __init__(self, bits: int, block_ids: int):
        import zstandard

        self.bits, self.size, self.packer = bits, block_ids, zstandard.ZstdCompressor(level=LEVEL)
        self.shard = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.held, self.n_held, self.first, self.block = [], 0, 0, 0
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # ids, begins in the shard, sizes

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[dict]:
        self.docs.append((doc_ids, self.first + self.n_held + np.cumsum(sizes) - sizes, sizes))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.size:
            yield from self._given(self.n_held // self.size)

    def end(self) -> Iterator[dict]:
        if self.n_held:
            yield from self._given(1)

    def _given(self, blocks: int) -> Iterator[dict]:
        ids = np.concatenate(self.held)
        names, begin, sizes = (np.concatenate(x) for x in zip(*self.docs, strict=True))
        for k in range(blocks):
            part = ids[k * self.size : (k + 1) * self.size].astype(np.uint32)
            a, b = np.searchsorted(begin + sizes, self.first, side="right"), np.searchsorted(begin, self.first + len(part))
            yield {
                "shard": self.shard, "block": self.block, "first": self.first, "n_ids": len(part), "bits": self.bits,
                "planes": [self.packer.compress(x) for x in to_planes(part, self.bits)], "ids_crc32": _crc(part),
                "docs": [{"doc_id": d, "at": int(x), "n": int(n)} for d, x, n in zip(names[a:b].tolist(), (begin[a:b] - self.first).tolist(), sizes[a:b].tolist(), strict=True)],
            }
            self.first, self.block = self.first + len(part), self.block + 1
        rest = ids[blocks * self.size :]
        open_from = np.searchsorted(begin + sizes, self.first, side="right")
        self.held, self.n_held = [rest], len(rest)
        self.docs = [(names[open_from:], begin[open_from:], sizes[open_from:])]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES, side="right")))
        yield i, j
        i = j


def encoded_blocks(ordered: DataFrame, vocabulary: str, end_id: int = 1, bits: int = 8, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Rows of blocks (``BLOCKS``) of ``(doc_id, text)``; each partition is a shard, in the order of its rows."""

    def run(batches):
        coder, blocks = WordBpe(vocabulary), _Blocks(bits, block_ids)
        rows = lambda found: [pa.RecordBatch.from_pylist([x], schema=_SCHEMA) for x in found]
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            for i, j in _slices(batch.column(1)):
                ids, ends = coder.encode(batch.column(1).slice(i, j - i))
                sizes = np.diff(ends) + 1
                whole = np.full(len(ids) + j - i, end_id, np.uint32)
                whole[np.arange(len(ids)) + np.repeat(np.arange(j - i), sizes - 1)] = ids
                yield from rows(blocks.add(names[i:j], whole, sizes))
        yield from rows(blocks.end())

    return ordered.select("doc_id", "text").mapInArrow(run, BLOCKS)


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, bits: int = 8, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text of ``docs`` and write the ids, ``end_id`` after each text, below ``folder``.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are ignored. A null text is an empty one, whose only
    id is ``end_id``. Documents come by ascending id, null ids first; rows that share an id come by a hash of their texts,
    and those that repeat a text, too, in any order (they are alike). An empty table gives files without blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"by_text": F.xxhash64("text"), "seq": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "by_text", "seq"]  # the last splits one row that is repeated very often
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded_blocks(ordered, vocabulary, end_id, bits, block_ids).write.option("compression", "none").parquet(f"{folder}/blocks")
    sizes = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n"), F.count(F.lit(1)).alias("blocks"))
    first, shards = 0, []
    for row in sorted(sizes.collect()):  # a row for each partition
        shards.append((row["shard"], first, row["n"], row["blocks"]))
        first += row["n"]
    spark.createDataFrame(shards, "shard int, shard_first long, shard_ids long, shard_blocks long").coalesce(1).write.parquet(f"{folder}/shards")


def _checked_blocks(spark: SparkSession, folder: str) -> DataFrame:
    shards = spark.read.parquet(f"{folder}/shards")  # there is none while files are incomplete
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").join(F.broadcast(shards), "shard")


def _parts(blocks: DataFrame, whole: bool) -> DataFrame:
    """``(doc_id, start, n_tokens, at, ids)`` of the documents that lie in one block (``whole``), or of their parts in each.

    A block whose ids do not have the CRC of the index is an error.
    """
    inside = lambda d: (d["at"] >= 0) & (d["at"] + d["n"] <= F.col("n_ids"))
    wanted = F.filter("docs", lambda d: inside(d) if whole else ~inside(d))
    rows = blocks.select((F.col("shard_first") + F.col("first")).alias("first"), "n_ids", "bits", "planes", "ids_crc32", wanted.alias("docs")).where(F.size("docs") > 0)

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = from_planes([unpack.decompress(x) for x in row["planes"]], row["bits"], row["n_ids"]).astype("<u4")
                if _crc(ids) != row["ids_crc32"]:
                    raise ValueError(f"the block at id {row['first']} is damaged")
                at = np.array([d["at"] for d in row["docs"]], np.int64)
                n = np.array([d["n"] for d in row["docs"]], np.int64)
                a, b = np.maximum(at, 0), np.minimum(at + n, len(ids))
                raw = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d["doc_id"] for d in row["docs"]], pa.int64()), pa.array(at + row["first"]), pa.array(n), pa.array(a + row["first"]),
                        pa.array([raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "at", "ids"],
                )

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, at long, ids binary")


def read_ids(spark: SparkSession, folder: str, between: tuple[int, int] | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of the documents that files of :func:`write_ids` hold.

    ``start`` is the number of ids before the document's, ``ids`` are little-endian unsigned 32-bit integers, the end id
    with them. With ``between`` (first, last) only the documents that begin in these places. Documents that lie in one
    block are cut out where it is read; only those on a border between blocks are put together by a shuffle.
    """
    blocks = _checked_blocks(spark, folder)
    if between:
        spans = F.exists("docs", lambda d: (d["at"] + F.col("first") + F.col("shard_first")).between(*between))
        blocks = blocks.where(spans)
    whole = _parts(blocks, True).select("doc_id", "start", "n_tokens", "ids")
    parts = _parts(blocks, False).groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    joined = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), ""))
    found = whole.unionByName(parts.select("doc_id", "start", "n_tokens", joined.alias("ids")))
    return found.where(F.col("start").between(*between)) if between else found


def id_array(ids: Column) -> Column:
    """Ids of :func:`read_ids` as an array of longs."""
    byte = lambda i, k: F.conv(F.hex(F.substring(ids, 4 * i + k, F.lit(1))), 16, 10).cast("long")
    places = F.sequence(F.lit(0), (F.length(ids) / 4).cast("int") - 1)
    values = F.transform(places, lambda i: byte(i, 1) + byte(i, 2) * 256 + byte(i, 3) * 65_536 + byte(i, 4) * 16_777_216)
    return F.when(F.length(ids) > 0, values).otherwise(F.array().cast("array<bigint>"))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
