"""Task queues and telemetry as Structured Streaming; each has a batch twin with the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from evidencespark.sources.shared import working_folder

CLAIMS = "task_id long, delivery_id long, sequence long"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def claims(deliveries: DataFrame) -> DataFrame:
    """Deliveries whose sequence is above all that their task has seen; the largest one is the task's state.

    Within a micro-batch deliveries count in order of arrival.
    """

    def claim(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(["arrived_at", "delivery_id"])
        seen = state.get[0] if state.exists else None
        before = frame["sequence"].cummax().shift()
        if seen is not None:
            before = before.fillna(seen).clip(lower=seen)
        newest = [x for x in (frame["sequence"].max(), seen) if x is not None and x == x]
        if newest:  # without any sequence a task has no state yet
            state.update((int(max(newest)),))
        yield frame.loc[before.isna() | (frame["sequence"] > before), ["task_id", "delivery_id", "sequence"]]

    return deliveries.groupBy("task_id").applyInPandasWithState(claim, CLAIMS, "seen long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by window and type; windows close when the watermark is ``late`` past them."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the source holds now, through the stream, as a table.

    Each micro-batch is written under its own number, so a batch that runs again replaces what it wrote before; in
    complete mode the last batch is the result.
    """
    spark = stream.sparkSession
    folder = working_folder(spark)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        last.append(number)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    names = sorted(set(last)) if mode == "append" else [max(last)]
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/out/batch={n}" for n in names])


def folded(rows: DataFrame, order: list[str], names: list[str], start: tuple, step: Callable[..., tuple[tuple, tuple]], schema: str) -> DataFrame:
    """``key``, ``seq`` and what ``step(state, *values of names)`` returns with the next state, over each key's rows in order.

    Rows come sorted and only the state goes on from batch to batch, so a key may have more rows than memory holds.
    """

    def run(batches):
        key, state = None, start
        for batch in batches:
            out = []
            values = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in names]
            for own, *now in zip(batch.column("key").to_pylist(), *values, strict=True):
                if own != key:
                    key, state = own, start
                state, row = step(state, *now)
                out.append(row)
            columns = [pa.array(list(c), from_pandas=True) for c in zip(*out, strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seq"), *columns], names=[c.split()[0] for c in schema.split(", ")])

    rows = rows.select(F.col("key").cast("long").alias("key"), F.col("seq").cast("long").alias("seq"), *[c for c in names if c not in ("key", "seq")])
    return rows.repartition("key").sortWithinPartitions("key", *[F.col(c).asc_nulls_last() for c in order]).mapInArrow(run, schema)


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """``(key, seq, wait)``: how long each request waits in a bucket of ``burst`` units that fills at ``rate`` a second.

    A fold over each key's requests ``(key, seq, at, cost)`` in order. A request that is larger than the bucket does
    not wait and empties it.
    """

    def step(state: tuple, at: float, cost: float) -> tuple[tuple, tuple]:
        level, now = state
        start = at if now is None else max(at, now)
        level = min(burst, level + (start - (start if now is None else now)) * rate)
        wait = 0.0 if cost > burst else max(0.0, (cost - level) / rate)
        return (max(0.0, level + wait * rate - cost), start + wait), (round(start + wait - at, 6),)

    requests = requests.withColumns({c: F.col(c).cast("double") for c in ("at", "cost")})
    return folded(requests, ["at", "seq"], ["at", "cost"], (burst, None), step, "key long, seq long, wait double")


#: The steps of retention, in hours.
RETENTION_HOURS = (168, 96, 48, 24, 6, 1)


def retention(samples: DataFrame, ladder: tuple[int, ...] = RETENTION_HOURS) -> DataFrame:
    """``(key, seq, hours, paused)`` of samples ``(key, seq, used, free)``, shares of the budget and of the disk.

    Retention steps down at 80 % used or below 20 % free, and up below 70 % used with 20 % free; intake pauses at
    90 % used or below 10 % free.
    """

    def step(state: tuple, used: float, free: float) -> tuple[tuple, tuple]:
        (at,) = state
        if used >= 0.8 or free < 0.2:
            at = min(at + 1, len(ladder) - 1)
        elif used < 0.7:
            at = max(at - 1, 0)
        return (at,), (ladder[at], bool(used >= 0.9 or free < 0.1))

    samples = samples.withColumns({c: F.col(c).cast("double") for c in ("used", "free")})
    return folded(samples, ["seq"], ["used", "free"], (0,), step, "key long, seq long, hours long, paused boolean")
