"""The folder that driver and executors share, and tables written there so that they are evaluated once."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def working_folder(spark: SparkSession, kind: str = "stream") -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, a local one if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="evidencespark-stream-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared folder and read it again: evaluated once, and what depends on it is cheap to recompute."""
    spark = df.sparkSession
    folder = working_folder(spark, name)
    df.write.parquet(folder)
    if not _written:
        atexit.register(_purge)
    _written.append((spark, folder))
    return spark.read.schema(df.schema).parquet(folder)


#: About how many rows of a large table a task joins, sorts and looks through at once.
TASK_ROWS = 1 << 19


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` to tasks of about ``TASK_ROWS`` rows, so that a task's memory does not grow with the table
    (shuffles by the session's number of partitions give larger ones); small tables stay as they are."""
    tasks = -(-rows.count() // TASK_ROWS)
    return rows.repartition(tasks, key) if tasks > 1 else rows


def _purge() -> None:
    for spark, folder in _written:
        with contextlib.suppress(Exception):  # the context may have ended before this process
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
