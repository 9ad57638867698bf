"""Fences and effects of ingestion over the order tables, each query beside SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidencespark.operators import commands, ingestion
from evidencespark.plans.queries import query
from evidencespark.sources.shared import dealt
from evidencespark.sources.tables import table

_TYPE = "CASE WHEN o_orderkey % 9 = 0 THEN 'CLEANUP_DATASET' WHEN o_orderkey % 9 = 1 THEN 'CLEANUP_DOCUMENT' ELSE 'INGEST_DOCUMENT' END"
_STATE = "CASE WHEN o_orderkey % 13 = {0} THEN 'SUCCEEDED' WHEN o_orderkey % 3 = {1} THEN 'PENDING' ELSE 'RUNNING' END"
_JOBS = f"""SELECT o_orderkey AS task_id, {_TYPE} AS task_type, {_STATE.format(5, 9)} AS task_status, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 20 END AS last_sequence, o_orderkey AS job_id, {_STATE.format(7, 9)} AS job_status, o_orderkey % 17 = 0 AS cancelled, o_orderkey % 6 // 5 AS job_generation,
  o_orderkey % 8 + 1 AS version, o_custkey AS document_id, o_custkey % 10 AS corpus_id FROM orders"""
_AGGREGATE = f"""j AS ({_JOBS}), d AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 12 = 0 THEN 'DELETED' ELSE 'READY' END AS document_status, c_custkey % 25 // 24 AS document_generation, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 5 END AS active_version FROM customer WHERE c_custkey % 30 <> 1),
t AS (SELECT j.*, document_status, document_generation, active_version, CASE WHEN corpus_id % 2 = 0 THEN 'DELETING' ELSE 'ACTIVE' END AS corpus_status, corpus_id // 9 AS corpus_generation FROM j LEFT JOIN d USING (document_id))"""


def _tasks(spark, sf_dir):
    """Orders as tasks of jobs, customers as their documents (some are gone, some deleted), in ten corpora."""
    both = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS task_id", f"{_TYPE} AS task_type", f"{_STATE.format(5, 9)} AS task_status", "CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 20 END AS last_sequence", "o_orderkey AS job_id", f"{_STATE.format(7, 9)} AS job_status",
        "o_orderkey % 17 = 0 AS cancelled", "o_orderkey % 6 DIV 5 AS job_generation", "o_orderkey % 8 + 1 AS version", "o_custkey AS document_id", "o_custkey % 10 AS corpus_id",
    )
    tasks = both.select("task_id", "job_id", "task_type", "task_status", "last_sequence")
    jobs = both.select("job_id", "corpus_id", "document_id", "job_status", "cancelled", "job_generation", "version")
    documents = table(spark, sf_dir, "customer").where("c_custkey % 30 <> 1").selectExpr("c_custkey AS document_id", "CASE WHEN c_custkey % 12 = 0 THEN 'DELETED' ELSE 'READY' END AS document_status", "c_custkey % 25 DIV 24 AS document_generation", "CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 5 END AS active_version")
    corpora = jobs.select("corpus_id").distinct().selectExpr("corpus_id", "CASE WHEN corpus_id % 2 = 0 THEN 'DELETING' ELSE 'ACTIVE' END AS corpus_status", "corpus_id DIV 9 AS corpus_generation")
    return ingestion.tasks_in_full(tasks, jobs, documents, corpora)


@query(f"""WITH {_AGGREGATE}, l AS (SELECT l_orderkey * 10 + l_linenumber AS delivery_id, CASE WHEN l_partkey % 40 = 0 THEN -l_orderkey ELSE l_orderkey END AS task_id, l_suppkey % 20 AS sequence, l_partkey, l_suppkey FROM lineitem),
x AS (SELECT DISTINCT ON (delivery_id) delivery_id, task_id, sequence FROM l ORDER BY delivery_id, sequence, task_id),
y AS (SELECT x.*, t.* EXCLUDE (task_id), greatest(last_sequence, max(sequence) OVER (PARTITION BY x.task_id ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS seen FROM x LEFT JOIN t ON t.task_id = x.task_id),
z AS (SELECT *, CASE WHEN task_status IS NULL THEN 'UNKNOWN_TASK' WHEN task_status = 'SUCCEEDED' THEN 'TASK_OVER' WHEN job_status = 'SUCCEEDED' THEN 'JOB_OVER' WHEN sequence <= seen THEN 'STALE_SEQUENCE' WHEN cancelled THEN 'CANCELLED'
  WHEN task_type = 'CLEANUP_DATASET' THEN CASE WHEN corpus_status <> 'DELETING' OR corpus_generation <> job_generation THEN 'STALE_GENERATION' END WHEN document_status IS NULL THEN 'NO_DOCUMENT' WHEN document_generation <> job_generation THEN 'STALE_GENERATION'
  WHEN task_type = 'INGEST_DOCUMENT' AND document_status = 'DELETED' THEN 'DELETED' END AS refusal FROM y)
SELECT delivery_id, task_id, sequence, refusal, CASE WHEN refusal IS NULL THEN CAST(count(*) FILTER (refusal IS NULL) OVER (PARTITION BY task_id ORDER BY delivery_id) AS BIGINT) END AS attempt FROM z""")
def task_claims(spark, sf_dir):
    """Lines of orders as deliveries of tasks: which are taken, and why others are not."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS delivery_id", "CASE WHEN l_partkey % 40 = 0 THEN -l_orderkey ELSE l_orderkey END AS task_id", "l_suppkey % 20 AS sequence")
    once = dealt(lines, "delivery_id").groupBy("delivery_id").agg(F.min(F.struct("sequence", "task_id")).alias("d")).select("delivery_id", "d.task_id", "d.sequence")
    return ingestion.claims(_tasks(spark, sf_dir), once)


@query(f"""WITH {_AGGREGATE}, f AS (SELECT o_orderkey AS task_id, o_orderdate AS at_time FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT document_id, version FROM j WHERE (document_id + version) % 10 > 0),
y AS (SELECT f.task_id, f.at_time, t.* EXCLUDE (task_id), b.version AS built FROM f JOIN t ON t.task_id = f.task_id LEFT JOIN b ON b.document_id = t.document_id AND b.version = t.version),
z AS (SELECT *, CASE WHEN task_status <> 'RUNNING' THEN 'NOT_RUNNING' WHEN task_type <> 'INGEST_DOCUMENT' THEN 'OTHER_TYPE' WHEN document_status IS NULL THEN 'NO_DOCUMENT' WHEN job_status <> 'RUNNING' THEN 'JOB_NOT_RUNNING' WHEN cancelled THEN 'CANCELLED' WHEN document_status = 'DELETED' THEN 'DELETED'
  WHEN document_generation <> job_generation THEN 'STALE_GENERATION' WHEN built IS NULL THEN 'NO_BUILD' END AS refusal FROM y),
w AS (SELECT *, greatest(active_version, max(CASE WHEN refusal IS NULL THEN version END) OVER (PARTITION BY document_id ORDER BY at_time, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS held FROM z)
SELECT task_id, coalesce(refusal, CASE WHEN version < held THEN 'ABANDONED' ELSE 'ACTIVE' END) AS outcome, CASE WHEN refusal IS NULL THEN greatest(held, version) ELSE held END AS active_version FROM w""")
def task_completions(spark, sf_dir):
    """Half of the tasks end in the order of their dates: which versions become active, and why others do not."""
    tasks = _tasks(spark, sf_dir)
    builds = tasks.where("(document_id + version) % 10 > 0").select("document_id", "version").distinct().withColumn("status", F.lit("BUILDING"))
    ended = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS task_id", "o_orderdate AS at")
    return ingestion.completions(tasks, builds, ended)


def _listed(rows: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """The rows of all tables as (table_name, row_key, state), to compare them in one query."""
    parts = []
    for name, df in rows.items():
        rest = [c for c in sorted(df.columns) if c not in keys[name]]
        text = lambda cs: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cs])
        parts.append(df.select(F.lit(name).alias("table_name"), text(keys[name]).alias("row_key"), text(rest).alias("state")))
    return reduce(DataFrame.unionByName, parts)


_KEYS = {"jobs": ["job_id"], "tasks": ["task_id"], "outbox": ["event_id"], "builds": ["document_id", "version"], "documents": ["document_id"], "fingerprints": ["job_id"], "keys": ["key"], "parents": ["id"]}


def _new(kind: str, *of: str) -> str:
    return "substr(sha256(concat_ws(chr(31), " + ", ".join([f"'{kind}'", *[f"coalesce(CAST({c} AS VARCHAR), '')" for c in of]]) + ")), 1, 32)"


_MADE = f"m AS (SELECT *, {_new('task', 'job_id')} AS task_id, {_new('outbox', 'job_id')} AS event_id FROM m0)"
_EFFECTS = """SELECT 'jobs' AS table_name, job_id AS row_key, concat_ws('|', document_id, generation, retries, coalesce(retry_of, '-'), 'PENDING', version) AS state FROM m
UNION ALL SELECT 'tasks', task_id, concat_ws('|', 0, job_id, 'PENDING') FROM m UNION ALL SELECT 'outbox', event_id, concat_ws('|', '{outbox}', task_id) FROM m UNION ALL SELECT 'builds', concat_ws('|', document_id, version), concat_ws('|', job_id, 'BUILDING') FROM m"""


@query(f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS seq, max(l_partkey) || '/' || l_linenumber AS key, l_orderkey AS document_id, max(l_partkey) * 7 + max(l_suppkey) AS fingerprint FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey, l_linenumber),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS nth FROM r), n AS (SELECT *, nth = 1 AND row_number() OVER (PARTITION BY fingerprint, nth ORDER BY seq) > 1 AS again FROM k),
c AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seq) + CASE WHEN document_id % 2 = 0 THEN document_id % 4 ELSE 0 END AS version FROM n WHERE nth = 1 AND NOT again AND fingerprint % 5 <> 0),
m0 AS (SELECT key, document_id, version, fingerprint, CASE WHEN document_id % 2 = 0 THEN document_id % 3 ELSE 1 END AS generation, 0 AS retries, NULL::VARCHAR AS retry_of, {_new('submit-job', 'key', 'seq')} AS job_id FROM c), {_MADE}
{_EFFECTS.format(outbox='WAITING_OBJECT')} UNION ALL SELECT 'fingerprints', job_id, concat_ws('|', document_id, fingerprint, 'PENDING') FROM m UNION ALL SELECT 'keys', key, concat_ws('|', document_id, job_id, task_id) FROM m
UNION ALL SELECT 'documents', CAST(document_id AS VARCHAR), concat_ws('|', 1, max(version) + 1, 'PENDING') FROM m WHERE document_id % 2 = 1 GROUP BY document_id""")
def submission_effects(spark, sf_dir):
    """The rows that the submissions of returned lines put into each table; documents of odd orders are new."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("part"), F.max("l_suppkey").alias("supplier"))
    r = lines.selectExpr("l_orderkey * 10 + l_linenumber AS seq", "part || '/' || l_linenumber AS key", "1 AS digest", "l_orderkey AS document_id", "part * 7 + supplier AS fingerprint")
    held = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS document_id", "o_orderkey % 3 AS generation", "o_orderkey % 4 AS version")
    decided = commands.submitted(r.select("fingerprint").where("fingerprint % 5 = 0").distinct(), held, r)
    decided = decided.join(r.select("seq", "key", "fingerprint"), "seq")
    return _listed(ingestion.submission_rows(decided, held), _KEYS)


@query(f"""WITH a AS (SELECT o_orderkey AS id, o_custkey AS document_id, o_orderkey % 5 AS version, o_orderkey % 3 AS generation, o_orderkey % 4 AS tries FROM orders WHERE o_orderkey % 10 = 3 AND o_orderstatus = 'F' AND o_orderkey % 4 < 3),
m0 AS (SELECT document_id, version, generation, tries + 1 AS retries, CAST(id AS VARCHAR) AS retry_of, {_new('retry-job', 'id', 'tries')} AS job_id FROM a), {_MADE}
{_EFFECTS.format(outbox='READY_TO_PUBLISH')} UNION ALL SELECT 'parents', CAST(id AS VARCHAR), CAST(tries + 1 AS VARCHAR) FROM a UNION ALL SELECT 'fingerprints', job_id, concat_ws('|', document_id, 'PENDING') FROM m""")
def retry_effects(spark, sf_dir):
    """The rows that retries of failed jobs put into each table."""
    jobs = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(NULL AS BIGINT) AS parent", "CASE o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status", "TRUE AS retryable", "o_orderkey % 4 AS tries", "o_custkey AS document_id", "o_orderkey % 5 AS version", "o_orderkey % 3 AS generation")
    accepted = commands.retried(jobs, jobs.where("id % 10 = 3").select("id")).where("outcome = 'CREATED'")
    return _listed(ingestion.retry_rows(jobs, accepted), _KEYS)


@query(f"""WITH d AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 12 = 0 THEN 'DELETED' ELSE 'READY' END AS status, c_custkey % 3 AS generation, c_custkey % 6 + 1 AS next_version, c_custkey % 7 > 0 AS has_object, CASE WHEN c_custkey % 10 = 4 THEN 'DELETING' ELSE 'ACTIVE' END AS corpus FROM customer WHERE c_custkey % 30 <> 1),
r AS (SELECT o_orderkey AS seq, o_custkey AS document_id FROM orders WHERE o_orderkey % 4 = 0),
x AS (SELECT seq, r.document_id, generation, next_version, CASE WHEN status IS NULL THEN 'NOT_FOUND' WHEN status = 'DELETED' THEN 'DELETED' WHEN NOT has_object THEN 'OBJECT_MISSING' WHEN corpus <> 'ACTIVE' THEN 'CORPUS_DELETING' ELSE 'CREATED' END AS outcome FROM r LEFT JOIN d USING (document_id)),
y AS (SELECT *, CASE WHEN outcome = 'CREATED' THEN next_version + row_number() OVER (PARTITION BY document_id ORDER BY seq) - 1 END AS version FROM x),
m0 AS (SELECT document_id, version, generation, 0 AS retries, NULL::VARCHAR AS retry_of, {_new('reindex-job', 'document_id', 'version')} AS job_id FROM y WHERE outcome = 'CREATED'), {_MADE}
{_EFFECTS.format(outbox='READY_TO_PUBLISH')} UNION ALL SELECT 'documents', CAST(document_id AS VARCHAR), CAST(max(version) + 1 AS VARCHAR) FROM m GROUP BY document_id
UNION ALL SELECT 'requests', CAST(seq AS VARCHAR), concat_ws('|', document_id, outcome, coalesce(CAST(version AS VARCHAR), '-')) FROM y""")
def reindex_effects(spark, sf_dir):
    """The rows that reindexing puts into each table, and what becomes of each request."""
    d = table(spark, sf_dir, "customer").where("c_custkey % 30 <> 1").selectExpr(
        "c_custkey AS document_id", "CASE WHEN c_custkey % 12 = 0 THEN 'DELETED' ELSE 'READY' END AS status", "c_custkey % 3 AS generation", "c_custkey % 6 + 1 AS next_version", "c_custkey % 7 > 0 AS has_object", "CASE WHEN c_custkey % 10 = 4 THEN 'DELETING' ELSE 'ACTIVE' END AS corpus_status"
    )
    rows, requests = ingestion.reindex_rows(d, table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").selectExpr("o_orderkey AS seq", "o_custkey AS document_id"))
    return _listed(rows | {"requests": requests}, _KEYS | {"requests": ["seq"]})
