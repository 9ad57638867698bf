"""Registered queries around answers: routes of messages, tool calls, places, tables of contents, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencespark.functions import places
from evidencespark.functions import text as T
from evidencespark.operators import contents, dialogue, fuse, ingest, search
from evidencespark.plans.queries import LINES, OVERLAP, _asked, _docs, query
from evidencespark.sources.tables import table

#: Wording put before messages, as the table has none that greets or refers back.
OPENINGS = ("你好呀！", "谢谢，辛苦了", "hi, how do I configure it", "你好，请问超时怎么配置？", "这个知识库的内容是什么", "总结上一条回答", "总结上一条，另外告诉我最大值", "那它呢", "这种方式可以吗", "上一条很好", "Hello ~")
_OPENING = f"[{', '.join(repr(x) for x in OPENINGS)}][(conv_id * 5 + turn) % {len(OPENINGS)} + 1]"
_GREETS = f"[{', '.join(repr(x) for x in dialogue.GREETINGS)}]"
ROUTES = f"""m AS (SELECT conv_id, turn, regexp_replace(CASE (conv_id * 7 + turn) % 4 WHEN 0 THEN text WHEN 1 THEN {_OPENING} || text ELSE {_OPENING} END, '^\\s+|\\s+$', '', 'g') AS q FROM conversations WHERE role = 'user'),
n AS (SELECT *, coalesce(lag(q) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before, regexp_replace(regexp_replace(q, '{dialogue.PUNCTUATION}', '', 'g'), '{dialogue.PARTICLES}', '') AS plain FROM m),
w AS (SELECT *, CASE WHEN len(list_filter({_GREETS}, lambda g: starts_with(lower(plain), g) AND length(plain) - length(g) <= {dialogue.GREETING_TAIL})) > 0 AND NOT regexp_matches(plain, '{dialogue.KNOWLEDGE}') THEN 'talk'
  WHEN regexp_matches(q, '{dialogue.CORPUS}') THEN 'ask'
  WHEN contains(q, '{dialogue.LAST_ANSWER}') AND regexp_matches(q, '{dialogue.REWORK}') THEN CASE WHEN regexp_matches(q, '{dialogue.NEW_FACT}') THEN 'ask' ELSE 'rework' END
  WHEN regexp_matches(q, '{dialogue.REFERS_BACK}') THEN CASE WHEN before = '' THEN 'unclear' ELSE 'follow' END ELSE 'ask' END AS way FROM n),
routes AS (SELECT conv_id, turn, CASE way WHEN 'talk' THEN 'ordinary' WHEN 'rework' THEN 'transform' WHEN 'ask' THEN 'knowledge' ELSE 'follow_up' END AS intent,
  CASE way WHEN 'talk' THEN 'reply' WHEN 'rework' THEN 'reuse' WHEN 'unclear' THEN 'clarify' ELSE 'retrieve' END AS action, CASE way WHEN 'ask' THEN q WHEN 'follow' THEN before || q END AS standalone_query FROM w)"""


def _routes(spark, sf_dir):
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), ((F.col("conv_id") * 5 + F.col("turn")) % len(OPENINGS) + 1).cast("int"))
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 4
    message = F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(opening, "text")).otherwise(opening)
    return dialogue.routed(table(spark, sf_dir, "conversations").withColumn("text", message))


@query(f"WITH {ROUTES} SELECT conv_id, turn, intent, action, standalone_query FROM routes")
def intent_route(spark, sf_dir):
    """Where each message of a user goes, and the query it stands for."""
    return _routes(spark, sf_dir)


@query(f"""WITH {ROUTES}, c AS (SELECT conv_id, arg_max(action, turn) AS action, count_if(action = 'retrieve') AS rounds FROM routes GROUP BY 1),
a AS (SELECT conv_id, bool_and(length(text) % 9 + 1 <= 8) AS ok FROM conversations WHERE role = 'assistant' GROUP BY 1),
e AS (SELECT c.*, coalesce(ok, TRUE) AS ok, CASE c.conv_id % 4 WHEN 0 THEN 'reply' WHEN 3 THEN NULL ELSE 'retrieve' END AS expected FROM c LEFT JOIN a USING (conv_id))
SELECT round(coalesce(count_if(action = expected)::DOUBLE / nullif(count(expected), 0), 1), 9) AS route_accuracy, round(coalesce(count_if(expected = 'retrieve' AND rounds > 0)::DOUBLE / nullif(count_if(expected = 'retrieve'), 0), 1), 9) AS required_retrieval_recall,
  round(coalesce(count_if(expected <> 'retrieve' AND rounds = 0)::DOUBLE / nullif(count_if(expected <> 'retrieve'), 0), 1), 9) AS no_retrieval_precision, round(coalesce(count_if(rounds <= 2)::DOUBLE / nullif(count(*), 0), 1), 9) AS loop_convergence,
  round(coalesce(count_if(ok)::DOUBLE / nullif(count(*), 0), 1), 9) AS citation_validity, count(*) AS cases FROM e""")
def agent_eval_ratios(spark, sf_dir):
    """Conversations as cases: their last action, the rounds of retrieval, and whether all answers cite what is there."""
    c = _routes(spark, sf_dir).groupBy("conv_id").agg(F.max_by("action", "turn").alias("action"), F.count_if(F.col("action") == "retrieve").alias("rounds"))
    answer = F.concat("text", F.lit(" ["), (F.length("text") % 9 + 1).cast("string"), F.lit("]"))
    answers = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", *T.renumbered(answer, F.lit(8)))
    a = answers.groupBy("conv_id").agg(F.bool_and("valid").alias("ok"))
    expected = F.when(F.col("conv_id") % 4 == 0, "reply").when(F.col("conv_id") % 4 != 3, "retrieve")
    cases = c.join(a, "conv_id", "left").select("action", "rounds", F.lit(2).alias("max_rounds"), F.coalesce("ok", F.lit(True)).alias("citations_ok"), expected.alias("expected"))
    return dialogue.case_ratios(cases)


@query("""WITH d AS (SELECT conv_id, turn, role, unnest(range(len(w))) AS nth, unnest(w) AS word FROM (SELECT conv_id, turn, role, string_split(text, ' ') AS w FROM conversations))
SELECT conv_id AS run, turn // 2 AS index, 'call-' || max(turn) AS id, arg_max(role, turn) AS name, sha256(string_agg(word || ' ', '' ORDER BY turn, nth)) AS arguments_sha256 FROM d GROUP BY 1, 2""")
def stream_assembly(spark, sf_dir):
    """Tool calls from parts: the words of two messages are the parts of a call, whose first ones carry id and name."""
    words = F.posexplode(F.split("text", " ", -1)).alias("nth", "word")
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", words)
    first = F.col("nth") == 0
    deltas = d.select(
        F.col("conv_id").alias("run"),
        F.floor(F.col("turn") / 2).cast("long").alias("index"),
        F.struct("turn", "nth").alias("at"),
        F.when(first, F.concat(F.lit("call-"), F.col("turn").cast("string"))).otherwise("").alias("id"),
        F.when(first, "function").otherwise("").alias("type"),
        F.when(first, F.col("role")).otherwise("").alias("name"),
        F.concat("word", F.lit(" ")).alias("arguments"),
    )
    return dialogue.assembled_calls(deltas).select("run", "index", "id", "name", F.sha2("arguments", 256).alias("arguments_sha256"))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, ordinal, CASE lang WHEN 'de' THEN 'pdf' WHEN 'fr' THEN 'pptx' ELSE 'text' END AS kind, CASE WHEN lang IN ('de', 'fr') THEN ordinal // 5 + 1 ELSE 0 END AS page FROM lines),
q AS (SELECT *, CASE WHEN kind = 'pdf' AND page > 2 THEN CAST(page - 2 AS VARCHAR) ELSE '' END AS printed, CASE WHEN kind = 'pdf' THEN 0 ELSE ordinal + 1 END AS line FROM p)
SELECT doc_id, ordinal, concat_ws(' · ', CASE WHEN printed <> '' THEN '文档第 ' || printed || ' 页（PDF 第 ' || page || ' 页）' WHEN kind = 'pdf' THEN 'PDF 第 ' || page || ' 页' WHEN page > 0 THEN '第 ' || page || ' 页' END, CASE WHEN line > 0 THEN 'L' || line || '–L' || line END) AS place FROM q""")
def locator_format(spark, sf_dir):
    """The place of each line: five lines a page, printed numbers from the third page of German texts on."""
    lines = ingest.line_chunks(table(spark, sf_dir, "documents")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "lang")
    kind = F.when(F.col("lang") == "de", "pdf").when(F.col("lang") == "fr", "pptx").otherwise("text")
    page = F.when(F.col("lang").isin("de", "fr"), F.floor(F.col("ordinal") / 5) + 1).otherwise(0).cast("long")
    p = lines.select("doc_id", "ordinal", kind.alias("kind"), page.alias("page"))
    printed = F.when((F.col("kind") == "pdf") & (F.col("page") > 2), (F.col("page") - 2).cast("string")).otherwise("")
    line = F.when(F.col("kind") == "pdf", 0).otherwise(F.col("ordinal") + 1).cast("long")
    return p.select("doc_id", "ordinal", places.place(F.col("kind"), printed, F.col("page"), line, line).alias("place"))


_SITE = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site, rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+/([^?#]*)', 1), '/') || '.html' AS path"


@query(f"""WITH o AS (SELECT page_id, {_SITE} FROM pages),
t AS (SELECT site, CASE WHEN page_id % 2 = 0 THEN 'T/toc' ELSE 'Toc' END || page_id || '.hhc' AS toc, '<object><param name="Name" value="x"><param name="Local" value="missing.html"></object><PARAM Name="Local" value="' || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END || upper(path) || '">' AS content FROM o WHERE page_id % 3 = 0),
e AS (SELECT site, lower(toc) AS toc, unnest(range(len(l))) AS nth, unnest(l) AS target FROM (SELECT site, toc, regexp_extract_all(content, '(?is)<param\\s[^>]*?name\\s*=\\s*"local"[^>]*?value\\s*=\\s*"([^"]*)"', 1) AS l FROM t)),
k AS (SELECT site, lower(ltrim(target, '/')) AS key, min(toc || '#' || nth) AS rank FROM e GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY o.site ORDER BY rank IS NULL, rank, lower(path), page_id) AS position FROM o LEFT JOIN k ON k.site = o.site AND k.key = lower(o.path)""")
def toc_order(spark, sf_dir):
    """Pages in the order of their hosts' tables of contents; a third of the pages bring a file that lists them."""
    p = table(spark, sf_dir, "pages")
    o = p.select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("site"), F.concat(F.rtrim(F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^?#]*)", 1), F.lit("/")), F.lit(".html")).alias("path"), "page_id")
    even = F.col("page_id") % 2 == 0
    content = F.concat(F.lit('<object><param name="Name" value="x"><param name="Local" value="missing.html"></object><PARAM Name="Local" value="'), F.when(even, "/").otherwise(""), F.upper("path"), F.lit('">'))
    tocs = o.where("page_id % 3 = 0").select("site", F.concat(F.when(even, "T/toc").otherwise("Toc"), F.col("page_id").cast("string"), F.lit(".hhc")).alias("toc_path"), content.alias("content"))
    return contents.in_order(o, tocs).select("page_id", "position")


@query(r"""WITH v AS (SELECT page_id, regexp_extract(url, '^[^?#]*') AS base, url FROM pages),
w AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN base || '.html?x=1#y' WHEN 1 THEN replace(base, '/', '\') || '.HTM' WHEN 2 THEN base || '/../a.html' WHEN 3 THEN base || '/.//%C3%A9t%20a+b.xhtml' ELSE url END AS value FROM v),
p AS (SELECT page_id, list_filter(string_split(url_decode(regexp_extract(regexp_replace(replace(trim(value), '\', '/'), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', ''), '^[^?#]*')), '/'), lambda x: x <> '' AND x <> '.') AS parts FROM w)
SELECT page_id, CASE WHEN NOT list_contains(parts, '..') AND regexp_matches(array_to_string(parts, '/'), '(?i)[^/]\.x?html?$') THEN array_to_string(parts, '/') END AS topic_path FROM p""")
def topic_paths(spark, sf_dir):
    """Paths of HTML topics in addresses of several forms; null for those that are none."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "^[^?#]*", 0).alias("base"))
    n = F.col("page_id") % 5
    value = (
        F.when(n == 0, F.concat("base", F.lit(".html?x=1#y")))
        .when(n == 1, F.concat(F.regexp_replace("base", "/", r"\\"), F.lit(".HTM")))
        .when(n == 2, F.concat("base", F.lit("/../a.html")))
        .when(n == 3, F.concat("base", F.lit("/.//%C3%A9t%20a+b.xhtml")))
        .otherwise(F.col("url"))
    )
    return p.select("page_id", places.topic_path(value).alias("topic_path"))


@query(f"""WITH {OVERLAP}, {LINES}, ch AS (SELECT doc_id, ordinal, ordinal // 3 AS topic FROM lines),
an AS (SELECT query_id, rank AS pos, record_id AS doc_id, record_id % 5 AS ordinal FROM sparse WHERE rank <= 6),
near AS (SELECT an.query_id, an.pos, c.doc_id, c.ordinal, c.ordinal - an.ordinal AS distance FROM an JOIN ch a USING (doc_id, ordinal) JOIN ch c ON c.doc_id = an.doc_id AND c.topic = a.topic AND abs(c.ordinal - an.ordinal) = 1
  WHERE NOT EXISTS (SELECT 1 FROM an x WHERE x.query_id = an.query_id AND x.doc_id = c.doc_id AND x.ordinal = c.ordinal)),
rows_ AS (SELECT query_id, doc_id, ordinal, pos, 0 AS distance FROM an UNION ALL SELECT query_id, doc_id, ordinal, pos, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, ordinal ORDER BY pos, abs(distance), distance) AS nth FROM near) WHERE nth = 1)
SELECT query_id, doc_id, ordinal, CAST(distance AS BIGINT) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY distance <> 0, pos, abs(distance), ordinal) AS place FROM rows_""")
def topic_neighbours(spark, sf_dir):
    """Six anchors of each query, then their neighbours in the same topic of three lines."""
    hits = search.overlap_topk(_docs(spark, sf_dir), _asked(spark, sf_dir)).where("rank <= 6")
    anchors = hits.select("query_id", F.col("rank").cast("long").alias("pos"), F.col("record_id").alias("doc_id"), F.lit(1).alias("version"), (F.col("record_id") % 5).cast("long").alias("ordinal"))
    lines = ingest.line_chunks(table(spark, sf_dir, "documents")).select("doc_id", F.lit(1).alias("version"), F.floor(F.col("ordinal") / 3).cast("string").alias("topic"), F.col("ordinal").cast("long").alias("ordinal"))
    return fuse.expanded(anchors, lines).select("query_id", "doc_id", "ordinal", "distance", "place")


@query(f"""WITH {LINES} SELECT doc_id, sha256(content) AS content_sha256, min(ordinal) AS ordinal, '[' || array_to_string(list_sort(list_distinct(list(ordinal // 5 + 1))), ',') || ']' AS pages FROM lines WHERE lang = 'de' GROUP BY 1, 2""")
def page_sets(spark, sf_dir):
    """Equal lines of a text as one chunk, with all pages that hold it as JSON."""
    lines = ingest.line_chunks(table(spark, sf_dir, "documents").where("lang = 'de'"))
    page = F.floor(F.col("ordinal") / 5) + 1
    one = lines.groupBy("doc_id", F.sha2("content", 256).alias("content_sha256")).agg(F.min("ordinal").cast("long").alias("ordinal"), F.array_sort(F.collect_set(page)).alias("pages"))
    return one.withColumn("pages", F.to_json("pages"))


@query(f"WITH {LINES} SELECT doc_id, 'EMPTY_DOCUMENT' AS code, FALSE AS retryable FROM documents d WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = d.doc_id)")
def empty_documents(spark, sf_dir):
    """Documents without any chunk: a failure that no retry mends."""
    d = table(spark, sf_dir, "documents")
    lost = d.select("doc_id").join(ingest.line_chunks(d).select("doc_id"), "doc_id", "left_anti")
    return lost.select("doc_id", F.lit("EMPTY_DOCUMENT").alias("code"), F.lit(False).alias("retryable"))


@query("""WITH h AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || CAST(event_id % 100 AS VARCHAR) || '.5 ' WHEN 1 THEN strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') WHEN 2 THEN 'soon' WHEN 3 THEN '-3' WHEN 4 THEN '' END AS header,
  CASE event_id % 4 WHEN 0 THEN 'insufficient_quota' WHEN 1 THEN 'Throttling.RateQuota' WHEN 2 THEN 'Arrearage' ELSE 'timeout' END AS code FROM events),
s AS (SELECT event_id, code, coalesce(TRY_CAST(trim(header) AS DOUBLE), epoch(date_trunc('second', try_strptime(header, '%a, %d %b %Y %H:%M:%S GMT'))) - epoch(TIMESTAMP '2024-01-15 00:00:00')) AS seconds FROM h)
SELECT event_id, CASE WHEN seconds >= 0 THEN seconds END AS wait_seconds, NOT contains(lower(code), 'rate') AND regexp_matches(lower(code), 'quota|balance|arrearage') AS quota_used_up FROM s""")
def provider_waits(spark, sf_dir):
    """How long to wait by a provider's header (seconds, an HTTP date or nothing of use), and whether waiting is in vain."""
    n = F.col("event_id")
    header = F.when(n % 6 == 0, F.concat(F.lit(" "), (n % 100).cast("string"), F.lit(".5 "))).when(n % 6 == 1, F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).when(n % 6 == 2, "soon").when(n % 6 == 3, "-3").when(n % 6 == 4, "")
    code = F.when(n % 4 == 0, "insufficient_quota").when(n % 4 == 1, "Throttling.RateQuota").when(n % 4 == 2, "Arrearage").otherwise("timeout")
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", places.retry_after(header, now).alias("wait_seconds"), places.quota_used_up(code).alias("quota_used_up"))


@query("""SELECT event_id, concat_ws(',', 'task.id=' || user_id, 'stage=' || event_type, CASE WHEN event_id % 2 = 0 THEN 'outcome=' || CAST(event_id % 3 AS VARCHAR) END) AS attributes FROM events""")
def attribute_redaction(spark, sf_dir):
    """What may be reported of an event: attributes on the list, never its contents."""
    n = F.col("event_id")
    whole = F.create_map(F.lit("task.id"), F.col("user_id").cast("string"), F.lit("prompt"), F.col("props"), F.lit("stage"), F.col("event_type"), F.lit("outcome"), F.when(n % 2 == 0, (n % 3).cast("string")), F.lit("Task.Id"), F.lit("x"))
    kept = F.transform(F.map_entries(places.public_attributes(whole)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(kept, ",").alias("attributes"))
