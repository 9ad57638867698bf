"""Further registered queries: query understanding, layout, projections, lifecycle edges, evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.functions import text as T
from evidencespark.operators import ingest
from evidencespark.plans.queries import LINES, query
from evidencespark.sources.tables import table

#: The English keywords of each intent, in the order that decides ties.
INTENTS = (
    ("troubleshooting", ("error", "failed", "failure", "exception", "crash", "timeout", "troubleshoot")),
    ("qos", ("qos", "reliability", "durability", "history", "deadline", "liveliness")),
    ("performance_tuning", ("performance", "tuning", "latency", "throughput", "jitter", "benchmark")),
    ("installation", ("install", "setup", "deploy", "prerequisite")),
    ("configuration", ("license", "configure", "configuration", "setting")),
    ("api_usage", ("api", "function", "parameter", "return", "example")),
)
_INTENT_ROWS = ", ".join(f"({i}, '{name}', '{word}')" for i, (name, words) in enumerate(INTENTS) for word in words)


@query(f"""WITH k(priority, intent, word) AS (VALUES {_INTENT_ROWS}),
s AS (SELECT conv_id, turn, priority, intent, count(*) AS score FROM conversations, k WHERE contains(lower(text), word) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, priority) AS nth FROM s)
SELECT c.conv_id, c.turn, coalesce(b.intent, 'general') AS intent, coalesce(b.score, 0) AS score FROM conversations c LEFT JOIN b ON b.conv_id = c.conv_id AND b.turn = c.turn AND nth = 1""")
def intent_classify(spark, sf_dir):
    """The intent with most keywords in a message; ties by priority."""
    text = F.lower(F.coalesce("text", F.lit("")))
    scores = F.array(*[F.struct(sum(F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words).cast("long").alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("intent")) for i, (name, words) in enumerate(INTENTS)])
    best = F.array_max(scores)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", best.alias("b"))
    return c.select("conv_id", "turn", F.when(F.col("b.score") > 0, F.col("b.intent")).otherwise("general").alias("intent"), F.col("b.score").alias("score"))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, ordinal // 5 AS page, substr(regexp_replace(lower(trim(content)), '[0-9]', '#', 'g'), 1, 160) AS key FROM lines),
n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM p GROUP BY 1), k AS (SELECT doc_id, key, count(DISTINCT page) AS on_pages FROM p GROUP BY 1, 2)
SELECT k.doc_id, sha256(key) AS key_sha256, on_pages FROM k JOIN n USING (doc_id) WHERE on_pages >= greatest(3, ceil(0.6 * pages))""")
def repeated_margins(spark, sf_dir):
    """Lines that repeat on most pages (five lines a page): headers and footers."""
    key = F.substring(F.regexp_replace(F.lower(F.trim("content")), "[0-9]", "#"), 1, 160)
    p = ingest.line_chunks(table(spark, sf_dir, "documents")).select("doc_id", F.floor(F.col("ordinal") / 5).alias("page"), key.alias("key"))
    k = p.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("on_pages"))
    n = p.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    return k.join(n, "doc_id").where(F.col("on_pages") >= F.greatest(F.lit(3), F.ceil(F.lit(0.6) * F.col("pages")))).select("doc_id", F.sha2("key", 256).alias("key_sha256"), "on_pages")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS n_paragraphs, len(regexp_extract_all(html, '<li><a href="([^"]*)"', 1)) AS n_links, regexp_extract(url, '^(?:https?)://([^/?#]+)', 1) AS host FROM pages""")
def page_outline(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).cast("long").alias("n_paragraphs"),
        F.size(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"),
        F.regexp_extract("url", "^(?:https?)://([^/?#]+)", 1).alias("host"),
    )


@query("SELECT o.o_orderkey AS document_id, coalesce(l.status, 'FAILED') AS status, l.status IS NULL AS stale FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS status FROM lineitem WHERE l_quantity > 40 GROUP BY 1) l ON l.l_orderkey = o.o_orderkey")
def document_job_status(spark, sf_dir):
    jobs = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(F.min("l_linestatus").alias("job"))
    j = table(spark, sf_dir, "orders").select("o_orderkey").join(jobs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select(F.col("o_orderkey").alias("document_id"), F.coalesce("job", F.lit("FAILED")).alias("status"), F.col("job").isNull().alias("stale"))


@query("SELECT l_suppkey AS key FROM lineitem WHERE l_returnflag = 'R' UNION SELECT s_suppkey FROM supplier WHERE s_acctbal < 0")
def cleanup_keys(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("key"))
    return a.union(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("key"))).distinct()


@query("""WITH s AS (SELECT user_id, event_id, ts, floor(least(greatest(value / 100, 0), 1) * 1000000) / 1000000 AS progress FROM events),
m AS (SELECT *, max(progress) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT user_id, event_id, round(progress, 6) AS progress FROM m WHERE before IS NULL OR progress > before""")
def monotone_progress(spark, sf_dir):
    p = F.floor(F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)) * 1_000_000) / 1_000_000
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", p.alias("progress"))
    before = F.max("progress").over(W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1))
    return e.withColumn("before", before).where("before IS NULL OR progress > before").select("user_id", "event_id", F.round("progress", 6).alias("progress"))


@query("""WITH b AS (SELECT event_type, CASE WHEN value <= 1 THEN 1 WHEN value <= 5 THEN 5 WHEN value <= 10 THEN 10 WHEN value <= 50 THEN 50 WHEN value <= 100 THEN 100 ELSE 500 END AS le FROM events),
h AS (SELECT event_type, le, count(*) AS n FROM b GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY le) AS upto, sum(n) OVER (PARTITION BY event_type) AS total, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS below FROM h),
q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le) AS nth FROM c WHERE upto >= 0.95::DOUBLE * total)
SELECT event_type, round(below + (le - below) * (0.95::DOUBLE * total - (upto - n)) / n, 6) AS p95 FROM q WHERE nth = 1""")
def histogram_quantile(spark, sf_dir):
    """The 95th percentile from cumulative buckets, by linear interpolation."""
    le = F.lit(500)
    for bound in (100, 50, 10, 5, 1):
        le = F.when(F.col("value") <= bound, bound).otherwise(le)
    h = table(spark, sf_dir, "events").groupBy("event_type", le.alias("le")).agg(F.count(F.lit(1)).alias("n"))
    own = W.partitionBy("event_type")
    c = h.withColumns({"upto": F.sum("n").over(own.orderBy("le")), "total": F.sum("n").over(own), "below": F.coalesce(F.lag("le").over(own.orderBy("le")), F.lit(0))})
    q = c.where(F.col("upto") >= 0.95 * F.col("total")).withColumn("nth", F.row_number().over(own.orderBy("le"))).where("nth = 1")
    share = (0.95 * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")
    return q.select("event_type", F.round(F.col("below") + (F.col("le") - F.col("below")) * share, 6).alias("p95"))


@query("""WITH m AS (SELECT conv_id, turn, octet_length(encode(text)) AS bytes FROM conversations), u AS (SELECT *, sum(bytes) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM m) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM u WHERE used <= 600""")
def tool_output_budget(spark, sf_dir):
    """The longest prefix of a conversation's outputs within 600 bytes."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))
    return m.withColumn("used", F.sum("bytes").over(W.partitionBy("conv_id").orderBy("turn"))).where("used <= 600").select("conv_id", "turn", "used")


@query("""WITH c AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS s FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents)),
f AS (SELECT doc_id, pos, min(pos) OVER (PARTITION BY doc_id, length(s) % 9) AS first FROM c), n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS number FROM f)
SELECT doc_id, string_agg(CAST(number AS VARCHAR), ',' ORDER BY pos) AS numbers, max(number) AS n_sources FROM n GROUP BY 1""")
def citation_renumber(spark, sf_dir):
    """References of a text numbered by first appearance; a sentence's reference is its number of letters modulo 9."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("pos", "s"))
    first = F.min("pos").over(W.partitionBy("doc_id", F.length("s") % 9))
    c = c.select("doc_id", "pos", first.alias("first"))
    c = c.withColumn("number", F.dense_rank().over(W.partitionBy("doc_id").orderBy("first")).cast("long"))
    rows = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "number"))).alias("rows"), F.max("number").alias("n_sources"))
    return rows.select("doc_id", F.array_join(F.transform("rows", lambda r: r["number"].cast("string")), ",").alias("numbers"), "n_sources")


@query("""SELECT event_id, event_type, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, len(json_keys(props)) AS n_keys FROM events WHERE props IS NOT NULL AND props <> ''""")
def trace_flatten(spark, sf_dir):
    """The attributes of an event's JSON object."""
    e = table(spark, sf_dir, "events").where("props IS NOT NULL AND props <> ''")
    keys = F.json_object_keys("props")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", "event_type", F.try_element_at(m, F.element_at(keys, 1)).alias("first_value"), F.size(keys).cast("long").alias("n_keys"))


@query("SELECT doc_id, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_à-öø-ÿœß]+|[一-鿿]')) AS t) WHERE length(t) > 12) AS long_terms, len(regexp_extract_all(lower(text), '[a-z0-9_à-öø-ÿœß]+|[一-鿿]')) AS n_terms FROM documents")
def term_stats(spark, sf_dir):
    t = T.terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(t, lambda x: F.length(x) > 12)).cast("long").alias("long_terms"), F.size(t).cast("long").alias("n_terms"))
