"""Shared helpers of the training-data operators.

Intermediate results that cut lineage are written as Parquet under the folder the session names in
``spark.checkpoint.dir``, so that any executor (and a retried stage) can read them.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Spark regex of one word: what lies between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir`` (a local one only where that is unset)."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="evidencespark-")
        _folders[app] = f"{base.rstrip('/')}/evidencespark-{app}"
        atexit.register(purge, spark)
    return _folders[app]


def purge(spark: SparkSession) -> None:
    """Delete what this application has written with :func:`stored`; results that still read it end."""
    try:
        folder = _folders.pop(spark.sparkContext.applicationId, None)
        if folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the context has ended before this process
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: evaluated once, cheap to recompute from."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 64):
    """Within it, rows go to Python and back in batches of at most ``rows``: for rows that are large themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def key_runs(batches, keys: int):
    """Tables of the rows whose first ``keys`` columns are equal; the rows come sorted by these."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for i in range(keys):
            column = pc.fill_null(batch.column(i), -1) if pa.types.is_integer(batch.column(i).type) else pc.fill_null(batch.column(i).cast(pa.string()), "")
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(new).tolist()
        first = [batch.column(i)[0].as_py() for i in range(keys)]
        if held and first != last:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for a, b in zip([0, *begins], [*begins, batch.num_rows], strict=True):
            if a and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
        last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(keys)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def list_parts(column) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and the n + 1 offsets of the lists in them."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, all other characters as they are (``lower`` alone would also change É)."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def held_out(doc_id: Column) -> Column:
    """True for the third of documents whose labels no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string array as one uint8 array, and the n + 1 offsets of its values in it; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
