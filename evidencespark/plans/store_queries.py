"""Keyword indexes, the keyed table, strict answers and nested traces, each query beside SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.functions import contracts
from evidencespark.operators import keywords, traces
from evidencespark.plans.queries import query
from evidencespark.sources.keyed import KeyedTable
from evidencespark.sources.shared import stored, working_folder
from evidencespark.sources.tables import table

# --- keyword indexes ----------------------------------------------------------------------------------------


def _index_tables(spark, sf_dir):
    """Ten index files. Customers are their leaf blocks (file by the last digit, chained in steps of seven; the chain of
    file 8 ends in a loop, that of file 9 nowhere), orders the entries of their customer's block, with two parts as
    topics (file 7 has entries of an unknown kind), and parts the topics of every file (file 6 has wrong links)."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    n = c.count() // 10
    file, block = F.col("c_custkey") % 10, F.floor(F.col("c_custkey") / 10).cast("long")
    after = (F.col("block") + 7) % n
    last = F.when(F.col("file") == 8, F.lit(7)).when(F.col("file") == 9, F.lit(n + 5)).otherwise(F.lit(keywords.END))
    leaves = c.select(file.alias("file"), block.alias("block")).withColumn("next_block", F.when(after == 0, last).otherwise(after).cast("long"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<bigint>")).alias("file"))
    parts = p.where("file = 0").count()
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("file"), F.floor(F.col("o_custkey") / 10).cast("long").alias("block"), F.col("o_orderkey").alias("nth"), "o_orderpriority")
    number = F.col("nth")
    word = F.when(number % 31 == 0, "   ").otherwise(F.concat("o_orderpriority", F.lit(" ,  Key"), (number % 40).cast("string")))
    kind = F.when((F.col("file") == 7) & (number % 50 == 3), 1).when(number % 23 == 0, 2).otherwise(0)
    entries = o.select("file", "block", "nth", word.alias("keyword"), kind.alias("see_also"), F.array(number % parts, number * 3 % parts).alias("topics"))
    key = F.col("p_partkey")
    topics = p.select("file", key.alias("topic"), F.when(key % 5 == 0, F.lit(keywords.NO_TITLE)).otherwise(key * 100).alias("title_offset"), (key * 12).alias("url_table_offset"))
    url_table = p.select("file", (key * 12).alias("offset"), F.when((F.col("file") == 6) & (key % 100 == 5), key + 1).otherwise(key).alias("topic"), (key * 64).alias("url_offset"))
    tail = F.concat(F.lit("\\docs\\"), F.translate("p_name", " ", "_"), F.lit(".html"), F.when(key % 2 == 0, F.concat(F.lit("#"), "p_brand")).otherwise(""))
    address = F.when(F.col("p_size") % 10 == 0, "..\\x.html").when(F.col("p_size") % 10 == 1, "c:/x.html").otherwise(tail)
    url_strings = p.select("file", (key * 64 + keywords.ADDRESS_HEAD).alias("offset"), address.alias("text"))
    titles = p.select("file", (key * 100).alias("offset"), F.concat(F.lit("  "), "p_name", F.lit("   x")).alias("text"))
    return leaves, entries, topics, url_table, url_strings, titles


_WALK = """nn AS (SELECT count(*) // 10 AS n FROM customer), pp AS (SELECT count(*) AS parts FROM part),
leaf AS (SELECT c_custkey % 10 AS file, c_custkey // 10 AS block, CASE WHEN (c_custkey // 10 + 7) % n <> 0 THEN (c_custkey // 10 + 7) % n WHEN c_custkey % 10 = 8 THEN 7 WHEN c_custkey % 10 = 9 THEN n + 5 ELSE 4294967295 END AS nxt FROM customer, nn),
walk AS (SELECT DISTINCT file, 0::BIGINT AS block, 0::BIGINT AS pos FROM leaf UNION ALL SELECT w.file, l.nxt, w.pos + 1 FROM walk w JOIN leaf l ON l.file = w.file AND l.block = w.block, nn WHERE l.nxt <> 4294967295 AND w.pos < n),
bad AS (SELECT file, max(error) AS error FROM (SELECT file, 'LOOP' AS error FROM walk, nn WHERE pos >= n UNION ALL SELECT w.file, 'BROKEN' FROM walk w LEFT JOIN leaf l ON l.file = w.file AND l.block = w.block WHERE l.file IS NULL) GROUP BY 1),
ent AS (SELECT w.file, w.pos, o_orderkey AS nth, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE o_orderpriority || ' , Key' || o_orderkey % 40 END AS keyword, CASE WHEN w.file = 7 AND o_orderkey % 50 = 3 THEN 1 WHEN o_orderkey % 23 = 0 THEN 2 ELSE 0 END AS kind,
  o_orderkey % parts AS t1, o_orderkey * 3 % parts AS t2 FROM orders JOIN walk w ON w.file = o_custkey % 10 AND w.block = o_custkey // 10, pp WHERE w.file NOT IN (SELECT file FROM bad)),
spoilt AS (SELECT DISTINCT file, 'LINK_TYPE' AS error FROM ent WHERE kind = 1),
rec AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY pos, nth) AS ordinal, keyword, t1, t2 FROM ent WHERE keyword <> '' AND kind = 0 AND file NOT IN (SELECT file FROM spoilt))"""
_TOPICS = """want AS (SELECT file, t1 AS topic FROM rec UNION SELECT file, t2 FROM rec),
wrong AS (SELECT DISTINCT file, 'OTHER_TOPIC' AS error FROM want WHERE file = 6 AND topic % 100 = 5),
addr AS (SELECT file, topic, p_name, CASE WHEN topic % 5 = 0 THEN '' ELSE p_name || ' x' END AS title, 'docs/' || replace(p_name, ' ', '_') || '.html' AS path, CASE WHEN topic % 2 = 0 THEN p_brand END AS anchor
  FROM want JOIN part ON p_partkey = topic WHERE p_size % 10 > 1 AND file NOT IN (SELECT file FROM wrong)),
refs AS (SELECT file, topic, CASE WHEN title <> '' THEN title ELSE replace(p_name, ' ', '_') END AS title, path || coalesce('#' || anchor, '') AS url, path, anchor FROM addr)"""


def _found(spark, sf_dir):
    leaves, entries, *links = _index_tables(spark, sf_dir)
    chain, broken = keywords.walked(leaves)
    found, spoilt = keywords.records(chain, entries)
    return stored(found, "keywords"), broken.unionByName(spoilt), links


@query(f"WITH RECURSIVE {_WALK} SELECT file, ordinal, keyword, NULL AS error FROM rec UNION ALL SELECT file, NULL, NULL, error FROM bad UNION ALL SELECT file, NULL, NULL, error FROM spoilt")
def keyword_records(spark, sf_dir):
    """The keywords of each index along its chain of blocks, and what is wrong with files that have none."""
    found, errors, _ = _found(spark, sf_dir)
    none = F.lit(None).cast("string")
    return found.select("file", "ordinal", "keyword", none.alias("error")).unionByName(errors.select("file", F.lit(None).cast("long").alias("ordinal"), none.alias("keyword"), "error"))


@query(f"WITH RECURSIVE {_WALK}, {_TOPICS} SELECT file, topic, title, url, path, anchor, NULL AS error FROM refs UNION ALL SELECT file, NULL, NULL, NULL, NULL, NULL, error FROM wrong")
def keyword_topics(spark, sf_dir):
    """The topics behind the offsets of each index."""
    found, _, links = _found(spark, sf_dir)
    refs, errors = keywords.topic_references(found, *links)
    columns = ("title", "url", "path", "anchor")
    none = F.lit(None).cast("string")
    refs = refs.select("file", "topic", *columns, none.alias("error"))
    return refs.unionByName(errors.select("file", F.lit(None).cast("long").alias("topic"), *[none.alias(c) for c in columns], "error"))


@query(f"""WITH RECURSIVE {_WALK}, {_TOPICS},
each AS (SELECT file, topic, min(ordinal) AS ordinal, arg_min(keyword, ordinal) AS keyword FROM (SELECT file, ordinal, keyword, t1 AS topic FROM rec UNION SELECT file, ordinal, keyword, t2 FROM rec) JOIN refs USING (file, topic) GROUP BY file, topic, lower(keyword)),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY file, topic ORDER BY ordinal) - 1) // 32 AS nth FROM each)
SELECT file, topic, nth, sha256(string_agg(keyword, chr(10) ORDER BY ordinal)) AS text_sha256, trim(string_split(arg_min(keyword, ordinal), ',')[-1]) AS symbol, min(ordinal) AS keyword_start, max(ordinal) AS keyword_end, count(*) AS n_keywords FROM numbered GROUP BY 1, 2, 3""")
def keyword_segments(spark, sf_dir):
    """The keywords of each topic, 32 a segment."""
    found, _, links = _found(spark, sf_dir)
    refs, _ = keywords.topic_references(found, *links)
    return keywords.segments(found, refs).withColumn("text_sha256", F.sha2("text", 256)).drop("text")


# --- keyed table --------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT o_orderkey AS record_id, o_custkey AS document_id, o_orderpriority AS note FROM orders),
c AS (SELECT l_orderkey AS record_id, l_partkey AS document_id, 'line ' || l_linenumber AS note, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS nth FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT record_id, document_id, note FROM c WHERE nth = 1 UNION ALL SELECT * FROM a WHERE record_id NOT IN (SELECT record_id FROM c)),
d AS (SELECT * FROM b WHERE document_id % 7 <> 0),
e AS (SELECT * FROM a WHERE record_id % 100 = 1)
SELECT 4 AS version, * FROM (SELECT * FROM e UNION ALL SELECT * FROM d WHERE record_id NOT IN (SELECT record_id FROM e)) UNION ALL SELECT 2, * FROM b""")
def keyed_changes(spark, sf_dir):
    """Orders put into a keyed table, changed by their returned lines, deleted by document, and some put in again: the
    newest version, and the second one as a reader still sees it."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("note"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    newest = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), F.desc("l_partkey")))
    lines = lines.withColumn("nth", newest).where("nth = 1").select(F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("document_id"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("note"))
    t = KeyedTable(spark, working_folder(spark, "keyed"), a.schema, "record_id", buckets=16)
    t.upsert(a)
    second = t.read(t.upsert(lines))
    t.delete("document_id % 7 = 0")
    newest = t.read(t.upsert(a.where("record_id % 100 = 1")))
    return newest.select(F.lit(4).alias("version"), "*").unionByName(second.select(F.lit(2).alias("version"), "*"))


# --- strict answers -----------------------------------------------------------------------------------------

#: Answers with @ in place of a number of the event: two good ones and others that break the contract.
ANSWERS = (
    '{"sufficient": true, "missing_facts": ["key @"], "reason_code": "k@"}', ' {"reason_code":"a\\u0041 \\"@\\"","missing_facts":[],"sufficient":false} ', '{"sufficient": true, "missing_facts": ["@"], "reason_code": "k"} {}',
    '{"sufficient": true, "missing_facts": ["@"], "reason_code": "k", "extra": 1}', '{"sufficient": true, "sufficient": true, "missing_facts": ["@"], "reason_code": "k"}', '{"sufficient": 1, "missing_facts": ["@"], "reason_code": "k"}',
    '{"missing_facts": ["@"], "reason_code": "k"}', '{"sufficient": true, "missing_facts": null, "reason_code": "k@"}', '{"sufficient": true, "missing_facts": ["1", "2", "3", "4", "5", "@"], "reason_code": "k"}', 'The answer is @.',
    '{"sufficient": true, "missing_facts": ["  ", "@"], "reason_code": "k"}', '{"sufficient": true, "missing_facts": ["@"], "reason_code": "  "}', '{"sufficient": true, "missing_facts": [null, "@"], "reason_code": "k"}', '[{"sufficient": true}, @]',
    '{"sufficient": true, "missing_facts": ["@",], "reason_code": "k"}', '{"sufficient": false, "missing_facts": ["@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@@"], "reason_code": "long"}',
)
_ANSWERS_SQL = ", ".join("'" + a.replace("'", "''") + "'" for a in ANSWERS)


@query(f"""WITH a AS (SELECT event_id, replace([{_ANSWERS_SQL}][event_id % {len(ANSWERS)} + 1], '@', coalesce(json_extract_string(props, '$.k'), '')) AS answer FROM events),
b AS (SELECT event_id, trim(answer) AS t, json_valid(trim(answer)) AND NOT regexp_matches(answer, ',\\s*[\\]}}]') AS ok FROM a),
c AS (SELECT *, CASE WHEN ok THEN json_keys(t) END AS k, CASE WHEN ok THEN json_type(t, '$.sufficient') END AS s, CASE WHEN ok THEN json_type(t, '$.missing_facts') END AS m, CASE WHEN ok THEN json_type(t, '$.reason_code') END AS r FROM b),
d AS (SELECT *, CASE WHEN m = 'ARRAY' THEN CAST(json_extract(t, '$.missing_facts') AS VARCHAR[]) END AS facts, CASE WHEN ok THEN trim(json_extract_string(t, '$.reason_code')) END AS reason FROM c),
e AS (SELECT *, CASE WHEN NOT (starts_with(t, '{{') AND ends_with(t, '}}')) THEN 'NOT_AN_OBJECT' WHEN NOT ok OR len(k) <> len(list_distinct(k)) OR len(list_filter(k, lambda x: x NOT IN ('sufficient', 'missing_facts', 'reason_code'))) > 0
  OR coalesce(s, 'NULL') NOT IN ('BOOLEAN', 'NULL') OR coalesce(m, 'NULL') NOT IN ('ARRAY', 'NULL') OR coalesce(r, 'NULL') NOT IN ('VARCHAR', 'NULL') THEN 'INVALID_JSON' WHEN coalesce(s, 'NULL') = 'NULL' OR coalesce(m, 'NULL') = 'NULL' OR coalesce(r, 'NULL') = 'NULL' THEN 'MISSING_FIELD'
  WHEN len(facts) > 5 THEN 'TOO_MANY_FACTS' WHEN len(list_filter(facts, lambda x: trim(coalesce(x, '')) = '')) > 0 THEN 'EMPTY_FACT' WHEN len(list_filter(facts, lambda x: length(x) > 256)) > 0 THEN 'FACT_TOO_LONG' WHEN reason = '' OR strlen(reason) > 64 THEN 'BAD_REASON' END AS error FROM d)
SELECT event_id, error, CASE WHEN error IS NULL THEN CAST(json_extract(t, '$.sufficient') AS BOOLEAN) END AS sufficient, CASE WHEN error IS NULL THEN array_to_string(facts, '|') END AS facts, CASE WHEN error IS NULL THEN reason END AS reason_code FROM e""")
def strict_answers(spark, sf_dir):
    """Answers of a model by their contract: what is wrong with each, or its fields."""
    e = table(spark, sf_dir, "events")
    picked = F.element_at(F.array(*map(F.lit, ANSWERS)), (F.col("event_id") % len(ANSWERS) + 1).cast("int"))
    answer = F.replace(picked, F.lit("@"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("")))
    error, sufficient, facts, reason = contracts.assessment(answer)
    return e.select("event_id", error.alias("error"), sufficient.alias("sufficient"), F.array_join(facts, "|").alias("facts"), reason.alias("reason_code"))


# --- traces -------------------------------------------------------------------------------------------------

_SERVICES = (*traces.SERVICES, "other")
_STAGES = (*traces.STAGES, "unknown", "")
_NAMES = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _traces(spark, sf_dir):
    """Events as traces of 400 each: a resource for each type of event, three scopes in each, a span for each event."""
    e = table(spark, sf_dir, "events")
    number, text = F.col("event_id"), F.col("event_id").cast("string")
    own = F.lpad(F.hex(number), 16, "0")
    span_id = F.when(number % 11 == 0, "zz").when(number % 7 == 0, F.base64(F.unhex(own))).otherwise(own)
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (number % len(xs) + 1).cast("int"))
    attributes = F.array(pair("stage", pick(_STAGES)), pair("outcome", pick(("succeeded", "retry", "lost"))), pair("error.code", pick(("E_1", "bad code!", ""))), pair("run.id", F.concat(F.lit("run-"), text)))
    span = F.struct(
        span_id.alias("span_id"), F.when(number % 3 == 0, "").otherwise(F.lpad(F.hex(number - 1), 16, "0")).alias("parent_id"), start.cast("string").alias("start_ns"),
        F.when(number % 13 == 0, "x").otherwise((start + F.floor("value") * 1000).cast("string")).alias("end_ns"), F.when(number % 17 == 0, "2").otherwise("0").alias("status"), attributes.alias("attributes"),
    )
    rows = e.select(F.floor(number / 400).cast("long").alias("trace_id"), "event_type", (number % 3).alias("scope"), number.alias("nth"), span.alias("span"))
    scopes = rows.groupBy("trace_id", "event_type", "scope").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "span"))), lambda x: x["span"]).alias("spans"))
    scopes = scopes.groupBy("trace_id", "event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("scope", "spans"))), lambda x: F.struct(x["spans"].alias("spans"))).alias("scopes"))
    order = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type")).cast("int")
    service = F.element_at(F.array(*map(F.lit, _SERVICES)), order)
    resources = scopes.select("trace_id", "event_type", F.struct(F.array(pair("service.name", service)).alias("attributes"), "scopes").alias("resource"))
    return resources.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "resource"))), lambda x: x["resource"]).alias("resources"))


@query(f"""WITH s AS (SELECT event_id // 400 AS trace_id, event_type, event_id % 3 AS scope, event_id, [{_NAMES(_SERVICES)}][list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)] AS service, CASE WHEN event_id % 11 = 0 THEN '' ELSE printf('%016x', event_id) END AS span_id,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE printf('%016x', event_id - 1) END AS parent_id, [{_NAMES(_STAGES)}][event_id % {len(_STAGES)} + 1] AS st, ['succeeded', 'retry', 'succeeded'][event_id % 3 + 1] AS oc, ['E_1', '', ''][event_id % 3 + 1] AS error_code, value FROM events),
n AS (SELECT *, coalesce(sum((span_id <> '')::INT) OVER (PARTITION BY trace_id ORDER BY event_type, scope, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE service <> 'other'),
t AS (SELECT *, bool_or(before >= 200) OVER (PARTITION BY trace_id) AS truncated FROM n)
SELECT trace_id, CAST(before + 1 AS BIGINT) AS nth, service, span_id, parent_id, CASE WHEN st IN ('unknown', '') THEN 'rpc' ELSE st END AS stage, CASE WHEN event_id % 17 = 0 THEN 'failed' ELSE oc END AS outcome, error_code, 'run-' || event_id AS run_id,
  CASE WHEN event_id % 13 = 0 THEN 0 ELSE greatest(floor(value) * 1000, 0) / 1e6::DOUBLE END AS duration_ms, truncated FROM t WHERE before < 200 AND span_id <> ''""")
def trace_spans(spark, sf_dir):
    """The spans of nested traces, 200 of each at most."""
    return traces.flattened(_traces(spark, sf_dir))
