"""What the two text classifiers share: labelled samples, folds and the scoring of whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.llm.common import free_name, held_out, text_bytes

#: Texts are scored in runs of about this many bytes, so that a task's memory does not follow its batch.
RUN_BYTES = 1 << 19


def runs(texts: pa.Array, run_bytes: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts' bytes and offsets in runs of about ``run_bytes`` (one text at least)."""
    data, offsets = text_bytes(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + run_bytes, side="right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 texts as code points, and the n + 1 offsets of the texts in them.

    Bytes that are no UTF-8 become U+FFFD, within their text.
    """
    try:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        begins = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        return points, begins[offsets]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode("utf-8", errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


#: Most bytes of texts that a classifier is fitted on.
SAMPLE_BYTES = 32 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``per_class`` labelled documents of each class outside the held-out fold.

    The bounds are the documented ones of the classifiers: ids are taken in the order of a hash, so reruns agree, each
    id with one text (of several rows that share it, the one whose text has the smallest hash), and whole texts as
    long as all together have at most ``max_bytes``. Ids or labels that are null are passed over; of several labels of
    one id the largest counts. At most ``2 * per_class`` ids are broadcast.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = F.struct(F.xxhash64("text").alias("hash"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    sizes = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(one).alias("of"), F.first("y").alias("y"))
    upto = F.sum("of.size").over(W.orderBy(F.xxhash64("doc_id"), "doc_id"))  # numbers of the bounded sample only
    chosen = sizes.withColumn("upto", upto).where(F.col("upto") <= max_bytes).select(F.col("doc_id").alias("_id"), F.col("of.hash").alias("_hash"), "y")
    rows = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
    return rows.groupBy("doc_id", "_hash").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("doc_id", "text", "y")


class FeatureRows:
    """``(y, indices, values)`` of the rows of a sample, kept compressed and unpacked one at a time, each time anew."""

    def __init__(self, packed: list):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for _, y, n, m, at, value in self.packed:
            steps = np.frombuffer(pa.decompress(at, 4 * n, codec="zstd"), "<i4")
            yield y, np.cumsum(steps, dtype=np.int32), np.frombuffer(pa.decompress(value, 4 * m, codec="zstd"), "<f4")


def packed_features(at: np.ndarray, value: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending indices by their steps, and values, compressed: a few bytes for each feature."""
    steps = np.diff(at.astype("<i4"), prepend=np.int32(0)).astype("<i4")
    return pa.compress(steps.tobytes(), codec="zstd", asbytes=True), pa.compress(value.astype("<f4").tobytes(), codec="zstd", asbytes=True)


def collect_features(sample: DataFrame, features: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> FeatureRows:
    """``(y, indices, values)`` of each row of the bounded sample, in a fixed order; computed on the executors.

    They come to the driver compressed, and stay so.
    """

    def extract(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            found = [features(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            packed = [packed_features(*x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("y"),
                    pa.array([len(x[0]) for x in found], pa.int64()),
                    pa.array([len(x[1]) for x in found], pa.int64()),
                    pa.array([x[0] for x in packed], pa.binary()),
                    pa.array([x[1] for x in packed], pa.binary()),
                ],
                names=["doc_id", "y", "n", "m", "at", "value"],
            )

    rows = sample.mapInArrow(extract, "doc_id long, y int, n long, m long, at binary, value binary").collect()
    return FeatureRows(sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1], r[2], bytes(r[4][:64]))))


def score_texts(docs: DataFrame, model, score: Callable, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``: ``score(model, bytes, offsets)`` of every whole text, in [0, 1].

    A column of ``docs`` that has that name already stays; the new one then gets underscores before it.
    """
    name = free_name(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            got = [score(shared.value, data, offsets) for data, offsets in runs(batch.column(at))]
            column = pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType(), False)]))
