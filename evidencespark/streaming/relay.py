"""Deliveries with retries and publication from an outbox, as Structured Streaming; each has a batch twin.

A delivery is tried when it comes. A try that fails and may be repeated is repeated after ``base`` seconds, then after
twice as long each time, until a try succeeds or the last one is used up. What waits is state of its delivery with a
timer on event time, so a restart goes on from the checkpoint, and a rerun gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evidencespark.sources.keyed import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tries of a task and of an object that is promoted; seconds before the first repetition.
TASK_TRIES, OBJECT_TRIES, BASE_SECONDS = 3, 5, 15
ATTEMPTS = "delivery_id long, attempt int, at_ms long, outcome string"
#: Fixed value: how many groups deliveries are dealt to by a hash; a checkpoint holds for this number.
GROUPS = 1024
#: A try that waits, as it lies in the state of its group; what has no time is never repeated.
WAITING = np.dtype([("delivery_id", "<i8"), ("due", "<i8"), ("attempt", "<i4"), ("failures", "<i4"), ("lasting", "?")])
NO_TIME = np.iinfo(np.int64).min


def outcome_of(attempt: int, failures: int, lasting: bool, most: int) -> str:
    """What becomes of a try: ``failed`` for good if the fault lasts or no try is left, else ``retry`` while faults go on."""
    if attempt > failures:
        return "done"
    return "failed" if lasting or attempt >= most else "retry"


class _Tries(StatefulProcessor):
    """One delivery for itself, as :class:`_TryGroups` has many. State: the number of the next try, when it is due, and
    what the delivery says of its faults."""

    def __init__(self, base_ms: int, most: int):
        self.base_ms, self.most = base_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "attempt int, due long, failures int, lasting boolean")

    def _go_on(self, key: int, attempt: int, due: int, failures: int, lasting: bool, now: int) -> Iterator[Row]:
        while True:
            outcome = outcome_of(attempt, failures, lasting, self.most)
            yield Row(delivery_id=key, attempt=attempt, at_ms=due, outcome=outcome)
            if outcome != "retry":
                self.waiting.clear()
                return
            due, attempt = due + self.base_ms * 2 ** (attempt - 1), attempt + 1
            if due > now:
                self.waiting.update((attempt, due, failures, lasting))
                self.handle.registerTimer(due)
                return

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803 - Spark's names
        first = min(rows, key=lambda r: r["at_ms"])  # a delivery that comes again while it waits is the same one
        if not self.waiting.exists():
            yield from self._go_on(int(key[0]), 1, first["at_ms"], first["failures"], first["lasting"], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.waiting.exists():
            attempt, due, failures, lasting = self.waiting.get()
            yield from self._go_on(int(key[0]), attempt, due, failures, lasting, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class _TryGroups(StatefulProcessor):
    """Deliveries of a group together, as calls for each one take longer than all else. State: the tries that wait, with
    one timer for the earliest."""

    def __init__(self, base_ms: int, most: int):
        self.base_ms, self.most = base_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "tries binary")

    def _held(self) -> np.ndarray:
        return np.frombuffer(self.waiting.get()[0], WAITING) if self.waiting.exists() else np.zeros(0, WAITING)

    def _hold(self, tries: np.ndarray, timer: int | None) -> None:
        """Keep ``tries``; ``timer`` is the one that is set."""
        if not len(tries):
            self.waiting.clear()
            return
        self.waiting.update((tries.tobytes(),))
        first = int(tries["due"].min())
        if timer != first:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)

    def _go_on(self, tries: np.ndarray, now: int) -> tuple[list[pd.DataFrame], np.ndarray]:
        """The rows of all tries due by ``now``, beginning with ``tries``, and the tries that wait then."""
        found, later = [], [np.zeros(0, WAITING)]
        while len(tries):
            done = tries["attempt"] > tries["failures"]
            failed = ~done & (tries["lasting"] | (tries["attempt"] >= self.most))
            outcome = np.where(done, "done", np.where(failed, "failed", "retry")).astype(object)
            at = pd.arrays.IntegerArray(tries["due"].copy(), tries["due"] == NO_TIME)
            found.append(pd.DataFrame({"delivery_id": tries["delivery_id"], "attempt": tries["attempt"], "at_ms": at, "outcome": outcome}))
            tries = tries[~done & ~failed & (tries["due"] != NO_TIME)]
            tries["due"] += np.int64(self.base_ms) << (tries["attempt"].astype(np.int64) - 1)
            tries["attempt"] += 1
            later.append(tries[tries["due"] > now])
            tries = tries[tries["due"] <= now]
        return found, np.concatenate(later)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        frame = pd.concat(list(rows))[["delivery_id", "at_ms", "failures", "lasting"]]
        if frame["delivery_id"].isna().any():
            raise ValueError("a delivery without its id")
        frame = frame.sort_values("at_ms", kind="stable").drop_duplicates("delivery_id")
        held = self._held()
        frame = frame[~frame["delivery_id"].isin(held["delivery_id"])]  # what comes again while it waits is the same one
        tries = np.zeros(len(frame), WAITING)
        tries["attempt"] = 1
        for name in ("delivery_id", "failures", "lasting"):
            tries[name] = frame[name].to_numpy()
        tries["due"] = np.where(frame["at_ms"].isna(), NO_TIME, frame["at_ms"].astype("Int64").fillna(0).to_numpy(np.int64))
        found, later = self._go_on(tries, timerValues.getCurrentWatermarkInMs())
        if len(later):
            self._hold(np.concatenate([held, later]), int(held["due"].min()) if len(held) else None)
        yield from found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        found, later = self._go_on(held[held["due"] <= now], now)
        self._hold(np.concatenate([held[held["due"] > now], later]), None)  # the timer that is over is taken off by Spark
        yield from found

    def close(self) -> None:
        pass


def tries(deliveries: DataFrame, base_seconds: int = BASE_SECONDS, most: int = TASK_TRIES, late: str = "0 seconds") -> DataFrame:
    """A stream of ``(delivery_id, attempt, at_ms, outcome)`` from a stream of (delivery_id, ts, failures, lasting).

    ``failures`` is how many tries fail, ``lasting`` whether repeating them is no use. A repetition shows once the
    watermark, ``late`` behind the newest delivery, has passed its time. Needs the RocksDB state store.
    """
    group = F.pmod(F.hash("delivery_id"), F.lit(GROUPS)).alias("group")
    rows = deliveries.withWatermark("ts", late).select(group, "delivery_id", "ts", F.unix_millis("ts").alias("at_ms"), "failures", "lasting")
    return rows.groupBy("group").transformWithStateInPandas(_TryGroups(base_seconds * 1000, most), ATTEMPTS, "Append", "EventTime")


def tries_batch(deliveries: DataFrame, base_seconds: int = BASE_SECONDS, most: int = TASK_TRIES, until_ms: int | None = None) -> DataFrame:
    """The same rows from a table, each delivery's tries at once; of repetitions those due by ``until_ms``."""
    last = F.when(F.col("lasting") & (F.col("failures") > 0), 1).otherwise(F.least(F.col("failures") + 1, F.lit(most)))
    rows = deliveries.select("delivery_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "failures", "lasting", F.explode(F.sequence(F.lit(1), last.cast("int"))).alias("attempt"))
    due = F.col("at") + base_seconds * 1000 * (F.pow(F.lit(2), F.col("attempt") - 1).cast("long") - 1)
    outcome = F.when(F.col("attempt") > F.col("failures"), "done").when(F.col("lasting") | (F.col("attempt") >= most), "failed").otherwise("retry")
    found = rows.select("delivery_id", "attempt", due.alias("at_ms"), outcome.alias("outcome"))
    return found if until_ms is None else found.where((F.col("attempt") == 1) | (F.col("at_ms") <= until_ms))


def publish(outbox: DataFrame, target: KeyedTable, checkpoint: str, order: str = "created_at"):
    """Put a stream of outbox rows into ``target``, by its key; returns the query, which ends when nothing is left.

    A batch that is written again, as after a crash between writing and its commit, replaces its own rows, so each is
    published once. ``order`` decides between rows of one key in a batch.
    """

    def write(batch: DataFrame, _: int) -> None:
        target.upsert(batch, order)

    return outbox.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
