"""Registered queries of commands and checks: orders stand for documents, their lines for jobs, builds and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencespark.operators import commands
from evidencespark.plans.queries import query
from evidencespark.sources.tables import table

_STATUS = "CASE l_returnflag WHEN 'N' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'RUNNING' ELSE 'PENDING' END WHEN 'R' THEN 'FAILED' ELSE 'SUCCEEDED' END"
_SEQ = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_TYPE = "CASE WHEN l_partkey % 4 = 0 THEN 'CLEANUP' ELSE 'INGEST' END"
_ID = "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey)"


def _lines(spark, sf_dir, *columns):
    return table(spark, sf_dir, "lineitem").selectExpr(*columns)


@query(f"""WITH r AS (SELECT {_SEQ} AS seq, l_partkey AS id, l_suppkey % 3 AS owner FROM lineitem), c AS (SELECT p_partkey AS id, p_size % 3 AS owner FROM part WHERE p_partkey % 2 = 0),
f AS (SELECT id, min_by(owner, seq) AS owner, min(seq) AS seq FROM r GROUP BY 1)
SELECT r.seq, r.id, CASE WHEN c.id IS NOT NULL THEN CASE WHEN c.owner = r.owner THEN 'EXISTING' ELSE 'CONFLICT' END WHEN r.seq = f.seq THEN 'CREATED' WHEN f.owner = r.owner THEN 'EXISTING' ELSE 'CONFLICT' END AS outcome
FROM r JOIN f ON f.id = r.id LEFT JOIN c ON c.id = r.id""")
def create_corpora(spark, sf_dir):
    current = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "CAST(p_size % 3 AS BIGINT) AS owner").where("id % 2 = 0")
    return commands.created(current, _lines(spark, sf_dir, f"{_SEQ} AS seq", "l_partkey AS id", "l_suppkey % 3 AS owner"))


@query("""SELECT o_orderkey AS id, coalesce(c.model, 'm' || (o_orderkey % 2)) AS model, coalesce(c.dimension, 64) AS dimension,
CASE WHEN c.model IS NULL THEN 'BOUND' WHEN c.model = 'm' || (o_orderkey % 2) AND c.dimension = 64 THEN 'SAME' ELSE 'EMBEDDING_MISMATCH' END AS outcome
FROM orders LEFT JOIN (SELECT l_orderkey AS id, 'm' || min(l_suppkey % 2) AS model, 64 AS dimension FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) c ON c.id = o_orderkey""")
def bind_profile(spark, sf_dir):
    held = _lines(spark, sf_dir, "l_orderkey AS id", "l_suppkey", "l_returnflag").where("l_returnflag = 'R'").groupBy("id").agg(F.concat(F.lit("m"), F.min(F.col("l_suppkey") % 2).cast("string")).alias("model"), F.lit(64).alias("dimension"))
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "'m' || CAST(o_orderkey % 2 AS STRING) AS model", "64 AS dimension")
    return commands.bound(held, asked)


@query(f"""WITH r AS (SELECT {_SEQ} AS seq, l_partkey || '/' || l_linenumber AS key, l_suppkey % 3 AS digest, l_orderkey AS document_id, l_partkey * 7 + l_suppkey AS fingerprint FROM lineitem),
k AS (SELECT *, first_value(digest) OVER w AS first, row_number() OVER w AS nth FROM r WINDOW w AS (PARTITION BY key ORDER BY seq)),
n AS (SELECT *, nth = 1 AND row_number() OVER (PARTITION BY fingerprint, nth ORDER BY seq) > 1 AS again FROM k),
o AS (SELECT *, CASE WHEN nth > 1 THEN CASE WHEN first = digest THEN 'REPLAY' ELSE 'IDEMPOTENCY_CONFLICT' END WHEN again OR fingerprint % 5 = 0 THEN 'REUSED' ELSE 'CREATED' END AS outcome FROM n)
SELECT seq, outcome, document_id, CASE WHEN outcome = 'CREATED' THEN document_id % 4 + count(*) FILTER (outcome = 'CREATED') OVER (PARTITION BY document_id ORDER BY seq) END AS version FROM o""")
def submit_ingestion(spark, sf_dir):
    r = _lines(spark, sf_dir, f"{_SEQ} AS seq", "l_partkey || '/' || l_linenumber AS key", "l_suppkey % 3 AS digest", "l_orderkey AS document_id", "l_partkey * 7 + l_suppkey AS fingerprint")
    versions = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS document_id", "o_orderkey % 4 AS version")
    return commands.submitted(r.select("fingerprint").where("fingerprint % 5 = 0").distinct(), versions, r)


@query("""WITH e AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'WAITING_OBJECT' WHEN 'O' THEN 'READY_TO_PUBLISH' ELSE 'CANCELLED' END AS status FROM orders),
x AS (SELECT l_orderkey AS id, bool_or(l_returnflag = 'A') AS stored, bool_or(l_returnflag = 'N') AS sent FROM lineitem GROUP BY 1)
SELECT e.id, CASE WHEN CASE WHEN status = 'WAITING_OBJECT' AND coalesce(stored, FALSE) THEN 'READY_TO_PUBLISH' ELSE status END = 'READY_TO_PUBLISH' AND coalesce(sent, FALSE) THEN 'PUBLISHED'
  WHEN status = 'WAITING_OBJECT' AND coalesce(stored, FALSE) THEN 'READY_TO_PUBLISH' ELSE status END AS status FROM e LEFT JOIN x ON x.id = e.id""")
def outbox_marks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'WAITING_OBJECT' WHEN 'O' THEN 'READY_TO_PUBLISH' ELSE 'CANCELLED' END AS status")
    events = _lines(spark, sf_dir, "l_orderkey AS id", "CASE l_returnflag WHEN 'A' THEN 'stored' WHEN 'N' THEN 'sent' END AS event").where("event IS NOT NULL")
    return commands.moved(rows, events, {"stored": ("WAITING_OBJECT", "READY_TO_PUBLISH"), "sent": ("READY_TO_PUBLISH", "PUBLISHED")})


@query("""WITH b AS (SELECT l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS version FROM lineitem WHERE l_linestatus = 'F'), t AS (SELECT document_id, max(version) AS top FROM b GROUP BY 1)
SELECT b.document_id, version, CASE WHEN version = top AND version > o_orderkey % 5 THEN 'ACTIVE' ELSE 'ABANDONED' END AS outcome FROM b JOIN t USING (document_id) JOIN orders ON o_orderkey = b.document_id""")
def complete_ingestion(spark, sf_dir):
    builds = _lines(spark, sf_dir, "l_orderkey AS document_id", "CAST(l_linenumber AS BIGINT) AS version", "l_linestatus").where("l_linestatus = 'F'")
    return commands.completed(builds, table(spark, sf_dir, "orders").selectExpr("o_orderkey AS document_id", "o_orderkey % 5 AS active_version"))


@query(f"SELECT {_ID} AS id, CASE WHEN l_tax > 0.03 AND l_discount > 0.04 THEN 'FAILED_RETRYABLE' ELSE 'RELEASED' END AS fingerprint_state FROM lineitem WHERE l_returnflag = 'R'")
def fail_tasks(spark, sf_dir):
    return commands.released(_lines(spark, sf_dir, f"{_ID} AS id", "l_tax > 0.03D AS retryable", "l_discount > 0.04D AS object_present", "l_returnflag").where("l_returnflag = 'R'"))


@query(f"""WITH j AS (SELECT {_ID} AS id, CASE WHEN l_linenumber > 1 THEN {_ID} - {_ID} % 1000000 - 1000000 + l_suppkey END AS parent, {_STATUS} AS status, l_tax > 0.02 AS retryable, l_suppkey % 5 AS tries FROM lineitem),
r AS (SELECT id FROM j WHERE id % 2 = 0 UNION SELECT -o_orderkey FROM orders WHERE o_orderkey % 50 = 0), b AS (SELECT DISTINCT parent AS id FROM j WHERE status IN ('PENDING', 'RUNNING') AND parent IS NOT NULL)
SELECT r.id, CASE WHEN j.id IS NULL THEN 'NOT_FOUND' WHEN status <> 'FAILED' OR NOT retryable THEN 'NOT_RETRYABLE' WHEN tries >= 3 THEN 'RETRY_LIMIT' WHEN b.id IS NOT NULL THEN 'RETRY_ACTIVE' ELSE 'CREATED' END AS outcome
FROM r LEFT JOIN j ON j.id = r.id LEFT JOIN b ON b.id = r.id""")
def retry_jobs(spark, sf_dir):
    jobs = _lines(spark, sf_dir, f"{_ID} AS id", f"CASE WHEN l_linenumber > 1 THEN {_ID} - {_ID} % 1000000 - 1000000 + l_suppkey END AS parent", f"{_STATUS} AS status", "l_tax > 0.02D AS retryable", "l_suppkey % 5 AS tries")
    missing = table(spark, sf_dir, "orders").selectExpr("-o_orderkey AS id").where("id % 50 = 0")
    return commands.retried(jobs, jobs.select("id").where("id % 2 = 0").unionByName(missing))


@query(f"""WITH j AS (SELECT {_ID} AS id, {_STATUS} AS status FROM lineitem), a AS (SELECT {_ID} AS id FROM lineitem WHERE l_suppkey % 2 = 0)
SELECT id, CASE WHEN status = 'PENDING' AND id IN (SELECT id FROM a) THEN 'CANCELLED' ELSE status END AS status, status = 'RUNNING' AND id IN (SELECT id FROM a) AS cancel_requested FROM j""")
def cancel_jobs(spark, sf_dir):
    jobs = _lines(spark, sf_dir, f"{_ID} AS id", f"{_STATUS} AS status")
    return commands.cancelled(jobs, _lines(spark, sf_dir, f"{_ID} AS id", "l_suppkey").where("l_suppkey % 2 = 0"))


_DOCS = "SELECT o_orderkey AS document_id, o_custkey AS corpus_id, CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'P' THEN 'DELETED' ELSE 'PENDING' END AS status, o_orderkey % 3 AS generation FROM orders"


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS document_id", "o_custkey AS corpus_id", "CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'P' THEN 'DELETED' ELSE 'PENDING' END AS status", "o_orderkey % 3 AS generation")


def _jobs(spark, sf_dir):
    return _lines(spark, sf_dir, f"{_ID} AS id", "l_orderkey AS document_id", f"{_TYPE} AS type", f"{_STATUS} AS status")


@query(f"""WITH d AS ({_DOCS}) SELECT document_id, CASE WHEN document_id % 4 = 0 THEN 'DELETED' ELSE status END AS status, generation + CASE WHEN document_id % 4 = 0 AND status <> 'DELETED' THEN 1 ELSE 0 END AS generation FROM d""")
def delete_documents(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return commands.deleted(d, _jobs(spark, sf_dir), d.where("document_id % 4 = 0"))[0]


@query(f"""WITH d AS ({_DOCS}), g AS (SELECT document_id FROM d WHERE corpus_id % 5 = 0 AND status <> 'DELETED'), j AS (SELECT {_ID} AS id, l_orderkey AS document_id, {_TYPE} AS type, {_STATUS} AS status FROM lineitem),
h AS (SELECT j.*, type = 'INGEST' AND document_id IN (SELECT document_id FROM g) AS hit FROM j)
SELECT id, document_id, type, CASE WHEN hit AND status = 'PENDING' THEN 'CANCELLED' ELSE status END AS status, hit AND status = 'RUNNING' AS cancel_requested FROM h
UNION ALL SELECT -document_id, document_id, 'CLEANUP', 'PENDING', FALSE FROM g WHERE document_id NOT IN (SELECT document_id FROM j WHERE type = 'CLEANUP' AND status IN ('PENDING', 'RUNNING'))""")
def delete_corpora(spark, sf_dir):
    """Every fifth corpus is deleted with its documents: what happens to jobs."""
    d = _documents(spark, sf_dir)
    return commands.deleted(d, _jobs(spark, sf_dir), d.where("corpus_id % 5 = 0"))[1]


@query("""SELECT l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS version, l_partkey AS chunk_id FROM lineitem
WHERE l_orderkey % 6 <> 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F' AND l_linenumber = o_orderkey % 3 + 1)""")
def purge_manifests(spark, sf_dir):
    """Manifests after cleanups: all of every sixth document's, and one version of each finished one's."""
    rows = _lines(spark, sf_dir, "l_orderkey AS document_id", "CAST(l_linenumber AS BIGINT) AS version", "l_partkey AS chunk_id")
    one = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey AS document_id", "o_orderkey % 3 + 1 AS version")
    whole = table(spark, sf_dir, "orders").where("o_orderkey % 6 = 0").selectExpr("o_orderkey AS document_id", "CAST(NULL AS BIGINT) AS version")
    return commands.purged(rows, one.unionByName(whole))


@query(f"""WITH d AS (SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT l_orderkey AS document_id FROM lineitem WHERE {_TYPE} = 'CLEANUP' AND {_STATUS} IN ('PENDING', 'RUNNING'))
SELECT -document_id AS id, document_id, 'CLEANUP' AS type, 'PENDING' AS status FROM d WHERE document_id NOT IN (SELECT document_id FROM b)""")
def schedule_cleanups(spark, sf_dir):
    return commands.scheduled(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS document_id").where("document_id % 2 = 0"), _jobs(spark, sf_dir))


@query("""WITH v AS (SELECT l_orderkey AS document_id, max(CAST(l_linenumber AS BIGINT)) AS latest, max(CASE WHEN l_linestatus = 'F' THEN CAST(l_linenumber AS BIGINT) END) AS visible FROM lineitem GROUP BY 1)
SELECT document_id, latest + 1 AS version, visible AS active_version FROM v""")
def reindex_documents(spark, sf_dir):
    """A new version of each document; the active one stays visible until the new one is complete."""
    v = _lines(spark, sf_dir, "l_orderkey AS document_id", "CAST(l_linenumber AS BIGINT) AS version", "l_linestatus = 'F' AS finished")
    return v.groupBy("document_id").agg((F.max("version") + 1).alias("version"), F.max(F.when(F.col("finished"), F.col("version"))).alias("active_version"))


@query("""WITH p AS (SELECT l_orderkey AS request_id, CASE WHEN l_partkey % 40 = 0 THEN 'bad key' WHEN l_partkey % 41 = 0 THEN '' ELSE 'k' || (l_partkey % 9) END AS key, 'v' || (l_suppkey % 2) AS value FROM lineitem),
k AS (SELECT request_id, key, min(value) AS value, count(DISTINCT value) > 1 OR NOT regexp_full_match(key, '[A-Za-z0-9_-]+') AS bad FROM p GROUP BY 1, 2)
SELECT request_id, CASE WHEN NOT bool_or(bad) THEN string_agg(key || '=' || value, '&' ORDER BY key) END AS filters, CASE WHEN bool_or(bad) THEN 'INVALID_FILTER' END AS error FROM k GROUP BY 1""")
def filter_maps(spark, sf_dir):
    pairs = _lines(spark, sf_dir, "l_orderkey AS request_id", "CASE WHEN l_partkey % 40 = 0 THEN 'bad key' WHEN l_partkey % 41 = 0 THEN '' ELSE 'k' || (l_partkey % 9) END AS key", "'v' || (l_suppkey % 2) AS value")
    maps = commands.filter_maps(pairs)
    text = F.array_join(F.transform(F.map_entries("filters"), lambda e: F.concat_ws("=", e["key"], e["value"])), "&")
    return maps.select("request_id", text.alias("filters"), "error")


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 'EMPTY_QUERY' WHEN conv_id % 7 = 0 OR (conv_id + turn) * 13 % 120 NOT BETWEEN 1 AND 100 THEN 'INVALID_TOP_K' WHEN turn % 6 < 1 THEN 'INVALID_BUDGET' WHEN conv_id % 3 = 0 THEN 'CORPUS_NOT_ACTIVE' END AS error FROM conversations""")
def request_validation(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").selectExpr(
        "struct(conv_id, turn) AS request_id", "CASE WHEN turn % 5 = 4 THEN ' ' ELSE text || '?' END AS query",
        "CASE WHEN conv_id % 7 = 0 THEN NULL ELSE (conv_id + turn) * 13 % 120 END AS top_k", "turn % 6 AS budget", "CASE WHEN conv_id % 3 = 0 THEN 'DELETING' ELSE 'ACTIVE' END AS corpus_status",
    )
    return commands.request_errors(c).select("request_id.conv_id", "request_id.turn", "error")
