"""Ids and views of jobs, panels of rates, and contexts whose tool results are blanked, each query beside SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencespark.functions import identity
from evidencespark.functions import text as T
from evidencespark.operators import lifecycle
from evidencespark.plans.queries import ORACLE_SQL, query
from evidencespark.sources.tables import table


@query("""WITH r AS (SELECT doc_id, source || '/' || doc_id AS key, left(text, 40) AS name, lang FROM documents),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('rag-dataset:' || key)) AS h FROM r)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr(h, 17, 1))::INT % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS corpus_id, 'staging/' || sha256(key) AS staging_key,
  sha256('{"name":' || to_json(name) || ',"operation":"reindex","target":' || CASE WHEN lang = 'en' THEN 'null' ELSE '"' || lang || '"' END || '}') AS digest FROM h""")
def request_identities(spark, sf_dir):
    """Ids, waiting places and digests of requests, one for each document."""
    key = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    digest = identity.request_digest({"operation": F.lit("reindex"), "name": F.substring("text", 1, 40), "target": F.when(F.col("lang") != "en", F.col("lang"))})
    return table(spark, sf_dir, "documents").select("doc_id", identity.corpus_id(key).alias("corpus_id"), identity.staging_key(key).alias("staging_key"), digest.alias("digest"))


@query("SELECT doc_id, sha256(replace(lower(text), 'ß', 'ss')) AS folded_sha256 FROM documents")
def folded_texts(spark, sf_dir):
    """Texts for comparison without case (of the letters of these texts only ß folds to something else than its lower case)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(identity.casefolded("text"), 256).alias("folded_sha256"))


_CODES = (*identity.FAILURES, "UNKNOWN_CODE")


@query(f"""WITH j AS (SELECT o_orderkey AS job_id, 'JOB_STATUS_' || CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'RUNNING' ELSE 'SUCCEEDED' END AS status, o_orderkey % 101 / 100.0::DOUBLE AS progress, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 11 > 0 THEN [{', '.join(f"'{c}'" for c in _CODES)}][o_orderkey % {len(_CODES)} + 1] END AS code, o_orderpriority AS message FROM orders)
SELECT job_id, replace(status, 'JOB_STATUS_', '') AS status, round(progress * 100, 6) AS progress, CASE {' '.join(f"WHEN code = '{c}' THEN '{m}'" for c, m in identity.FAILURES.items())} WHEN code IS NOT NULL THEN message ELSE '' END AS error_message FROM j""")
def job_views(spark, sf_dir):
    """Jobs as users see them: plain states, per cent, and what a failure means."""
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("o_orderkey") % len(_CODES) + 1).cast("int"))
    code = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 11 > 0), code)
    status = F.concat(F.lit("JOB_STATUS_"), F.when(F.col("o_orderstatus") == "F", "FAILED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("SUCCEEDED"))
    progress = F.col("o_orderkey") % 101 / 100.0
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.regexp_replace(status, "^JOB_STATUS_", "").alias("status"), F.round(progress * 100, 6).alias("progress"), identity.failure_message(code, F.col("o_orderpriority")).alias("error_message")
    )


@query("""WITH e AS (SELECT event_type, epoch_us(ts) / 1e6::DOUBLE AS t FROM events), z AS (SELECT CAST(floor(max(t)) AS BIGINT) AS ending FROM e),
s AS (SELECT DISTINCT event_type, ending - 86400 + 1440 * unnest(range(61)) AS sampled FROM e, z)
SELECT s.event_type AS name, s.sampled, round(count(*) / 300.0::DOUBLE, 9) AS value FROM s JOIN e ON e.event_type = s.event_type AND e.t > s.sampled - 300 AND e.t <= s.sampled GROUP BY 1, 2""")
def metrics_panel(spark, sf_dir):
    """The rates of the last day of the table at sixty steps, by type of event."""
    e = table(spark, sf_dir, "events")
    end = e.agg(F.floor(F.max(F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6)).first()[0]
    return lifecycle.panel(e, int(end or 0), "24h", "event_type")


def _blanked_sql() -> str:
    head, tail = ORACLE_SQL["context_trim"].replace("<= 200", "<= 120").rsplit("SELECT conv_id, turn, CAST(needed + own AS BIGINT) AS used FROM u", 1)
    note = lifecycle.BLANK_TOKENS
    return f"""{head.rstrip()}, kept AS (SELECT conv_id, turn, role, tokens FROM u{tail}),
b AS (SELECT *, role = 'tool' AND turn > min(turn) OVER (PARTITION BY conv_id) AS tool, sum(tokens) OVER (PARTITION BY conv_id) - 120 AS over, count(*) OVER (PARTITION BY conv_id) AS n FROM kept),
c AS (SELECT *, tool AND n > 2 AND over - coalesce((SELECT sum(p.tokens - {note}) FROM b p WHERE p.conv_id = b.conv_id AND p.tool AND p.turn < b.turn), 0) > 0 AS blanked FROM b)
SELECT conv_id, turn, blanked, CAST(CASE WHEN blanked THEN {note} ELSE tokens END AS BIGINT) AS tokens FROM c"""


@query(_blanked_sql())
def context_blanked(spark, sf_dir):
    """What stays of each conversation in 120 tokens, with results of tools blanked where that is still too much."""
    c = table(spark, sf_dir, "conversations")
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), "tool").otherwise(F.col("role"))
    calls = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    m = c.select("conv_id", "turn", role.alias("role"), calls.alias("calls_tools"), T.message_estimate(F.col("text")).alias("tokens"))
    return lifecycle.blanked_tools(lifecycle.trimmed_context(m, 120, 0), 120, 0).select("conv_id", "turn", "blanked", "tokens")
