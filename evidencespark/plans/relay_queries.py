"""Streams with retries and publication, compared with SQL over the tables they read."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencespark.plans.queries import query
from evidencespark.sources.keyed import KeyedTable
from evidencespark.sources.shared import working_folder
from evidencespark.streaming import relay, tasks


def _deliveries(events):
    """Events as deliveries: the remainders of their ids say how often a try fails and whether the fault lasts."""
    number = F.col("event_id")
    return events.select(number.alias("delivery_id"), F.col("ts").cast("timestamp").alias("ts"), (number % 5).cast("int").alias("failures"), (number % 7 == 0).alias("lasting"))


@query(f"""WITH d AS (SELECT event_id AS delivery_id, epoch_us(ts) // 1000 AS t, CAST(event_id % 5 AS INT) AS failures, event_id % 7 = 0 AS lasting FROM events),
e AS (SELECT max(t) AS newest FROM d),
a AS (SELECT delivery_id, t, failures, lasting, unnest(range(1, CASE WHEN lasting AND failures > 0 THEN 2 ELSE least(failures + 1, 3) + 1 END)) AS attempt FROM d),
b AS (SELECT delivery_id, CAST(attempt AS INT) AS attempt, t + {relay.BASE_SECONDS * 1000} * (CAST(2 ** (attempt - 1) AS BIGINT) - 1) AS at_ms, CASE WHEN attempt > failures THEN 'done' WHEN lasting OR attempt >= 3 THEN 'failed' ELSE 'retry' END AS outcome FROM a)
SELECT b.* FROM b, e WHERE attempt = 1 OR at_ms <= newest""")
def delivery_tries_stream(spark, sf_dir):
    """Every try of every delivery, from a stream: repeated after 15 and 30 seconds, three tries at most."""
    source = _deliveries(tasks.table_stream(spark, sf_dir, "events"))
    folder = working_folder(spark, "tries")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, relay.ROCKSDB)
    try:
        out = relay.tries(source).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(f"{folder}/rows")


@query("""SELECT user_id AS task_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS created_at FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def outbox_relay_stream(spark, sf_dir):
    """The last purchase of each user, published from a stream into a keyed table."""
    source = tasks.table_stream(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("task_id"), "event_id", "ts")
    source = source.select("task_id", "event_id", F.col("ts").alias("created_at"))
    target = KeyedTable(spark, working_folder(spark, "outbox"), source.schema, "task_id", buckets=8)
    relay.publish(source, target, working_folder(spark, "relay")).awaitTermination()
    return target.read()
