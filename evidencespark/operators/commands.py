"""Commands on versioned documents as plans over whole tables: each returns the rows that a batch of commands leaves.

Batches are sets of requests in an order; of requests that exclude each other the first wins, as a database with
locks would have it. Tables are joined by their keys, so a command costs one shuffle of the tables it changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.sources.shared import dealt

#: Jobs that are not over, and how often one is tried again.
OPEN = ("PENDING", "RUNNING")
MOST_RETRIES = 3


def created(current: DataFrame, requests: DataFrame) -> DataFrame:
    """``(seq, id, outcome)`` of requests ``(seq, id, owner)``: CREATED, EXISTING for the same owner, else CONFLICT."""
    first = F.min_by("owner", "seq").over(W.partitionBy("id"))
    nth = F.row_number().over(W.partitionBy("id").orderBy("seq"))
    r = requests.withColumns({"first": first, "nth": nth}).join(current.select("id", F.col("owner").alias("held"), F.lit(True).alias("there")), "id", "left")
    outcome = F.when(F.col("there") & ~F.col("held").eqNullSafe(F.col("owner")), "CONFLICT").when(F.col("there"), "EXISTING")
    outcome = outcome.when(F.col("nth") == 1, "CREATED").when(F.col("first").eqNullSafe(F.col("owner")), "EXISTING").otherwise("CONFLICT")
    return r.select("seq", "id", outcome.alias("outcome"))


def bound(corpora: DataFrame, requests: DataFrame) -> DataFrame:
    """``(id, model, dimension, outcome)``: a profile is bound to a corpus once; then only the same one is accepted."""
    r = requests.select("id", F.col("model").alias("asked"), F.col("dimension").alias("asked_dimension"))
    j = r.join(corpora.select("id", "model", "dimension"), "id", "left")
    same = (F.col("model") == F.col("asked")) & (F.col("dimension") == F.col("asked_dimension"))
    outcome = F.when(F.col("model").isNull(), "BOUND").when(same, "SAME").otherwise("EMBEDDING_MISMATCH")
    return j.select("id", F.coalesce("model", "asked").alias("model"), F.coalesce("dimension", "asked_dimension").alias("dimension"), outcome.alias("outcome"))


def submitted(fingerprints: DataFrame, versions: DataFrame, requests: DataFrame) -> DataFrame:
    """``(seq, outcome, document_id, version)`` of requests ``(seq, key, digest, document_id, fingerprint)``.

    A key seen before with the same digest is a REPLAY, with another one an IDEMPOTENCY_CONFLICT; a known fingerprint is
    REUSED; all others are CREATED, with the document's next versions in order.
    """
    by_key = W.partitionBy("key").orderBy("seq")
    r = requests.withColumns({"first": F.first("digest").over(by_key), "nth": F.row_number().over(by_key)})
    r = r.join(fingerprints.select("fingerprint", F.lit(True).alias("known")), "fingerprint", "left")
    fresh = F.col("nth") == 1
    again = F.row_number().over(W.partitionBy("fingerprint", "nth").orderBy("seq")) > 1
    r = r.withColumn("again", fresh & again)
    outcome = F.when(~fresh, F.when(F.col("first") == F.col("digest"), "REPLAY").otherwise("IDEMPOTENCY_CONFLICT"))
    r = r.withColumn("outcome", outcome.when(F.col("known") | F.col("again"), "REUSED").otherwise("CREATED"))
    r = r.join(versions.select("document_id", F.col("version").alias("latest")), "document_id", "left")
    made = F.count_if(F.col("outcome") == "CREATED").over(W.partitionBy("document_id").orderBy("seq"))
    version = F.when(F.col("outcome") == "CREATED", F.coalesce("latest", F.lit(0)) + made)
    return r.select("seq", "outcome", "document_id", version.cast("long").alias("version"))


def moved(rows: DataFrame, events: DataFrame, steps: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with the ``status`` that ``events(id, event)`` leave: an event moves a row only from its own state.

    Events of a row take effect in the order of ``steps``, so that those of one batch chain.
    """
    seen = events.groupBy("id").agg(F.collect_set("event").alias("events"))
    status = F.col("status")
    for event, (before, after) in steps.items():
        status = F.when((status == before) & F.coalesce(F.array_contains("events", event), F.lit(False)), after).otherwise(status)
    return rows.join(seen, "id", "left").withColumn("status", status).drop("events")


def completed(builds: DataFrame, active: DataFrame) -> DataFrame:
    """``(document_id, version, outcome)`` of finished builds: ACTIVE for a document's largest one above the active
    version, else ABANDONED; an active version never goes back."""
    top = F.max("version").over(W.partitionBy("document_id"))
    b = builds.withColumn("top", top).join(active.select("document_id", "active_version"), "document_id", "left")
    wins = (F.col("version") == F.col("top")) & (F.col("version") > F.coalesce("active_version", F.lit(0)))
    return b.select("document_id", "version", F.when(wins, "ACTIVE").otherwise("ABANDONED").alias("outcome"))


def released(failures: DataFrame) -> DataFrame:
    """What a failed task leaves of its fingerprint: it can be tried again only if the object is there."""
    state = F.when(F.col("retryable") & F.col("object_present"), "FAILED_RETRYABLE").otherwise("RELEASED")
    return failures.select("id", state.alias("fingerprint_state"))


def retried(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``(id, outcome)`` of requests to retry failed jobs ``(id, parent, status, retryable, tries)``.

    One try at a time (a child that is not over blocks another), and at most ``MOST_RETRIES``.
    """
    busy = jobs.where(F.col("status").isin(*OPEN) & F.col("parent").isNotNull()).select(F.col("parent").alias("id"), F.lit(True).alias("busy")).distinct()
    j = requests.select("id").distinct().join(jobs.select("id", "status", "retryable", "tries"), "id", "left").join(busy, "id", "left")
    outcome = (
        F.when(F.col("status").isNull(), "NOT_FOUND")
        .when((F.col("status") != "FAILED") | ~F.col("retryable"), "NOT_RETRYABLE")
        .when(F.col("tries") >= MOST_RETRIES, "RETRY_LIMIT")
        .when(F.col("busy"), "RETRY_ACTIVE")
        .otherwise("CREATED")
    )
    return j.select("id", outcome.alias("outcome"))


def cancelled(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """``(id, status, cancel_requested)``: a pending job is over at once, a running one is asked to end."""
    j = jobs.select("id", "status").join(requests.select("id", F.lit(True).alias("asked")).distinct(), "id", "left")
    asked = F.coalesce("asked", F.lit(False))
    status = F.when(asked & (F.col("status") == "PENDING"), "CANCELLED").otherwise(F.col("status"))
    return j.select("id", status.alias("status"), (asked & (F.col("status") == "RUNNING")).alias("cancel_requested"))


def deleted(documents: DataFrame, jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and jobs after the documents ``ids(document_id)`` are deleted: hidden at once with a new generation,
    their ingest jobs ended or asked to end, and one cleanup each that has none under way."""
    gone = ids.select("document_id", F.lit(True).alias("gone")).distinct()
    d = documents.join(gone, "document_id", "left")
    now = F.coalesce(F.col("gone") & (F.col("status") != "DELETED"), F.lit(False))
    d = d.withColumn("now", now)
    docs = d.select("document_id", F.when(F.col("now"), "DELETED").otherwise(F.col("status")).alias("status"), (F.col("generation") + F.col("now").cast("long")).alias("generation"))
    fresh = d.where("now").select("document_id")
    j = dealt(jobs, "document_id").join(fresh.withColumn("hit", F.lit(True)), "document_id", "left")
    hit = F.coalesce(F.col("hit") & (F.col("type") == "INGEST"), F.lit(False))
    j = j.select(
        "id", "document_id", "type",
        F.when(hit & (F.col("status") == "PENDING"), "CANCELLED").otherwise(F.col("status")).alias("status"),
        (hit & (F.col("status") == "RUNNING")).alias("cancel_requested"),
    )
    return docs, j.unionByName(scheduled(fresh, jobs).select("id", "document_id", "type", "status", F.lit(False).alias("cancel_requested")))


def scheduled(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """A cleanup job for each document that has none under way."""
    busy = jobs.where((F.col("type") == "CLEANUP") & F.col("status").isin(*OPEN)).select("document_id")
    free = documents.select("document_id").distinct().join(busy, "document_id", "left_anti")
    return free.select((-F.col("document_id")).alias("id"), "document_id", F.lit("CLEANUP").alias("type"), F.lit("PENDING").alias("status"))


def purged(rows: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Manifests or builds without those of the ``(document_id, version)`` that a cleanup has removed; a null version
    stands for all of a document's."""
    whole = cleaned.where("version IS NULL").select("document_id").distinct()
    some = cleaned.where("version IS NOT NULL").select("document_id", "version").distinct()
    return rows.join(whole, "document_id", "left_anti").join(some, ["document_id", "version"], "left_anti")


def filter_maps(pairs: DataFrame) -> DataFrame:
    """``(request_id, filters, error)`` of ``pairs(request_id, key, value)``: an empty key, a key with other letters than
    ``A-Za-z0-9_-``, or two values of one key are an INVALID_FILTER."""
    values = pairs.groupBy("request_id", "key").agg(F.min("value").alias("value"), (F.count_distinct("value") > 1).alias("several"))
    bad = F.max(F.col("several") | ~F.coalesce(F.col("key").rlike("^[A-Za-z0-9_-]+$"), F.lit(False)))
    maps = values.groupBy("request_id").agg(bad.alias("bad"), F.sort_array(F.collect_list(F.struct("key", "value"))).alias("pairs"))
    return maps.select("request_id", F.when(~F.col("bad"), F.map_from_entries("pairs")).alias("filters"), F.when(F.col("bad"), "INVALID_FILTER").alias("error"))


def request_errors(requests: DataFrame) -> DataFrame:
    """Retrieval requests ``(request_id, query, top_k, budget, corpus_status)`` with their first ``error``, null if valid."""
    error = (
        F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "EMPTY_QUERY")
        .when(~F.coalesce(F.col("top_k").between(1, 100), F.lit(False)), "INVALID_TOP_K")
        .when(~F.coalesce(F.col("budget") >= 1, F.lit(False)), "INVALID_BUDGET")
        .when(~F.col("corpus_status").eqNullSafe(F.lit("ACTIVE")), "CORPUS_NOT_ACTIVE")
    )
    return requests.select("request_id", error.alias("error"))
