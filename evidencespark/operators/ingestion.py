"""The life of an ingestion: what a submission, a retry and a reindex put into the tables, and the fences on the way.

Every function takes whole tables and a batch of requests, and gives rows: decisions with their reason, or the rows
that each table gets. Ids of new rows are digests of what they are made for, so a batch that runs again makes the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.sources.shared import dealt

OPEN = ("PENDING", "RUNNING")
#: The columns of a decision on a task: what is known of it, its job, its document and its corpus, in one row.
TASK = ("task_id", "task_type", "task_status", "last_sequence", "job_id", "job_status", "cancelled", "job_generation", "version", "document_id", "document_status", "document_generation", "active_version", "corpus_status", "corpus_generation")


def new_id(kind: str, *of: Column) -> Column:
    """An id of 32 letters for a new row, by what it is made for."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("")) for c in of]), 256), 1, 32)


def tasks_in_full(tasks: DataFrame, jobs: DataFrame, documents: DataFrame, corpora: DataFrame) -> DataFrame:
    """The rows ``TASK`` of tasks(task_id, job_id, task_type, task_status, last_sequence), jobs(job_id, corpus_id, document_id,
    job_status, cancelled, job_generation, version), documents(document_id, document_status, document_generation,
    active_version) and corpora(corpus_id, corpus_status, corpus_generation); a task without a job has no row."""
    rows = tasks.join(jobs, "job_id").join(documents, "document_id", "left").join(corpora, "corpus_id", "left")
    return rows.select(*TASK)


def claims(tasks: DataFrame, deliveries: DataFrame) -> DataFrame:
    """``(delivery_id, task_id, sequence, refusal, attempt)`` of deliveries (delivery_id, task_id, sequence) by ``TASK`` rows.

    A delivery is taken (null ``refusal``) if its task and job are not over, its sequence is above all that the task has
    seen, nobody asked to cancel, and the document (for a cleanup of a corpus: the corpus, which must be about to
    go) is of the job's generation, and for an ingestion not deleted. Deliveries come in the order of their ids;
    ``attempt`` counts those of the batch that were taken.
    """
    rows = dealt(deliveries, "task_id").join(tasks, "task_id", "left")
    before = W.partitionBy("task_id").orderBy("delivery_id")
    seen = F.max("sequence").over(before.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_seen", F.greatest("last_sequence", seen))
    whole = F.col("task_type") == "CLEANUP_DATASET"
    gone = whole & ~((F.col("corpus_status") == "DELETING") & F.col("corpus_generation").eqNullSafe(F.col("job_generation")))
    refusal = (
        F.when(F.col("task_status").isNull(), "UNKNOWN_TASK")
        .when(~F.col("task_status").isin(*OPEN), "TASK_OVER")
        .when(~F.col("job_status").isin(*OPEN), "JOB_OVER")
        .when(F.col("sequence") <= F.col("_seen"), "STALE_SEQUENCE")
        .when(F.col("cancelled"), "CANCELLED")
        .when(gone, "STALE_GENERATION")
        .when(~whole & F.col("document_generation").isNull(), "NO_DOCUMENT")
        .when(~whole & (F.col("document_generation") != F.col("job_generation")), "STALE_GENERATION")
        .when((F.col("task_type") == "INGEST_DOCUMENT") & (F.col("document_status") == "DELETED"), "DELETED")
    )
    rows = rows.withColumn("refusal", refusal)
    taken = F.sum(F.col("refusal").isNull().cast("int")).over(before)
    return rows.select("delivery_id", "task_id", "sequence", "refusal", F.when(F.col("refusal").isNull(), taken).cast("long").alias("attempt"))


def completions(tasks: DataFrame, builds: DataFrame, finished: DataFrame) -> DataFrame:
    """``(task_id, outcome, active_version)`` of ``finished(task_id, at)`` by ``TASK`` rows and builds(document_id, version, status).

    Only a running ingestion whose job runs, whose document is there, not deleted and of the job's generation, and whose
    build is under way counts; one that was asked to cancel ends as ``CANCELLED``. A version below one that is active, or
    that became so earlier in the batch, is ``ABANDONED`` and to be cleaned up; others are ``ACTIVE``. The active
    version after it never goes back.
    """
    rows = finished.join(tasks, "task_id", "left").join(builds.withColumnRenamed("status", "_build"), ["document_id", "version"], "left")
    refusal = (
        F.when(~F.col("task_status").eqNullSafe(F.lit("RUNNING")), "NOT_RUNNING")
        .when(F.col("task_type") != "INGEST_DOCUMENT", "OTHER_TYPE")
        .when(F.col("document_status").isNull(), "NO_DOCUMENT")
        .when(F.col("job_status") != "RUNNING", "JOB_NOT_RUNNING")
        .when(F.col("cancelled"), "CANCELLED")
        .when(F.col("document_status") == "DELETED", "DELETED")
        .when(F.col("document_generation") != F.col("job_generation"), "STALE_GENERATION")
        .when(~F.col("_build").eqNullSafe(F.lit("BUILDING")), "NO_BUILD")
    )
    rows = rows.withColumn("_refusal", refusal)
    good = F.when(F.col("_refusal").isNull(), F.col("version"))
    earlier = F.max(good).over(W.partitionBy("document_id").orderBy("at", "task_id").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_active", F.greatest("active_version", earlier))
    outcome = F.coalesce("_refusal", F.when(F.col("version") < F.col("_active"), "ABANDONED").otherwise("ACTIVE"))
    after = F.when(F.col("_refusal").isNull(), F.greatest("_active", "version")).otherwise(F.col("_active"))
    return rows.select("task_id", outcome.alias("outcome"), after.cast("long").alias("active_version"))


def _job(kind: str, made_for: list[Column], **columns: Column) -> list[Column]:
    job = new_id(f"{kind}-job", *made_for)
    return [job.alias("job_id"), new_id("task", job).alias("task_id"), new_id("outbox", job).alias("event_id"), *[c.alias(n) for n, c in columns.items()]]


def _rows(made: DataFrame, outbox: str) -> dict[str, DataFrame]:
    """The rows of each table for new jobs (job_id, task_id, event_id, document_id, version, generation, retry_of, retries)."""
    pending = F.lit("PENDING").alias("status")
    return {
        "jobs": made.select("job_id", "document_id", "version", "generation", pending, "retries", "retry_of"),
        "tasks": made.select("task_id", "job_id", pending, F.lit(0).alias("attempt")),
        "outbox": made.select("event_id", "task_id", F.lit(outbox).alias("status")),
        "builds": made.select("document_id", "version", "job_id", F.lit("BUILDING").alias("status")),
    }


def submission_rows(decided: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """What the submissions that were ``CREATED`` put into each table.

    ``decided`` are (seq, key, outcome, document_id, version, fingerprint), as decided before; ``documents`` hold the
    (document_id, generation) of those that are there, others are new ones of generation 1. The object is still to
    be stored, so the outbox waits for it; the fingerprint is taken, and the key remembers its job.
    """
    new = decided.where("outcome = 'CREATED'").join(documents.select("document_id", F.col("generation").alias("_held")), "document_id", "left")
    none = F.lit(None).cast("string")
    made = new.select(*_job("submit", [F.col("key"), F.col("seq")], document_id=F.col("document_id"), version=F.col("version"), generation=F.coalesce("_held", F.lit(1)).cast("long"), retries=F.lit(0), retry_of=none), "key", "fingerprint", "_held")
    return _rows(made, "WAITING_OBJECT") | {
        "documents": made.where("_held IS NULL").groupBy("document_id").agg(F.lit(1).cast("long").alias("generation"), (F.max("version") + 1).alias("next_version"), F.lit("PENDING").alias("status")),
        "fingerprints": made.select("fingerprint", "document_id", "job_id", F.lit("PENDING").alias("state")),
        "keys": made.select("key", "document_id", "job_id", "task_id"),
    }


def retry_rows(jobs: DataFrame, accepted: DataFrame) -> dict[str, DataFrame]:
    """What retries of ``accepted(id)`` put into each table, by jobs(id, document_id, version, generation, tries).

    A retry is a new job of the same version and generation, whose task may be sent at once; it counts on its parent
    too, takes its fingerprint, and its build is under way again.
    """
    old = jobs.join(accepted.select("id").distinct(), "id")
    made = old.select(*_job("retry", [F.col("id"), F.col("tries")], document_id=F.col("document_id"), version=F.col("version"), generation=F.col("generation"), retries=(F.col("tries") + 1), retry_of=F.col("id").cast("string")))
    return _rows(made, "READY_TO_PUBLISH") | {
        "parents": old.select("id", (F.col("tries") + 1).alias("tries")),
        "fingerprints": made.select("document_id", "job_id", F.lit("PENDING").alias("state")),
    }


def reindex_rows(documents: DataFrame, requests: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What reindexing puts into each table, and ``(seq, document_id, outcome, version)`` of each request.

    ``documents`` are (document_id, status, generation, next_version, has_object, corpus_status), ``requests`` (seq,
    document_id). Each request takes the next version of its document; what is active stays visible until that is done.
    """
    rows = requests.join(documents, "document_id", "left")
    refusal = (
        F.when(F.col("status").isNull(), "NOT_FOUND")
        .when(F.col("status") == "DELETED", "DELETED")
        .when(~F.col("has_object"), "OBJECT_MISSING")
        .when(~F.col("corpus_status").eqNullSafe(F.lit("ACTIVE")), "CORPUS_DELETING")
    )
    nth = F.row_number().over(W.partitionBy("document_id").orderBy("seq"))
    rows = rows.withColumn("outcome", F.coalesce(refusal, F.lit("CREATED"))).withColumn("version", F.when(F.col("outcome") == "CREATED", F.col("next_version") + nth - 1))
    none = F.lit(None).cast("string")
    made = rows.where("outcome = 'CREATED'").select(*_job("reindex", [F.col("document_id"), F.col("version")], document_id=F.col("document_id"), version=F.col("version"), generation=F.col("generation"), retries=F.lit(0), retry_of=none))
    counted = made.groupBy("document_id").agg((F.max("version") + 1).alias("next_version"))
    return _rows(made, "READY_TO_PUBLISH") | {"documents": counted}, rows.select("seq", "document_id", "outcome", "version")
