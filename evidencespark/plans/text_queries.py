"""Registered queries on texts: analysis of queries, sections of code, procedures, topics of pages, citations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.functions import text as T
from evidencespark.operators import analysis, ingest, topics
from evidencespark.plans.queries import LINES, query
from evidencespark.sources.tables import table

#: Wording put after messages, as these have none of the domain's own.
PROBES = (
    "how to use DW qos", "create data writer fails with DDS_RETCODE_TIMEOUT", "dp history depth not working", "DDS_DataReaderQos example",
    "install and deploy", "throughput is low, latency is high", "DDS_LIVELINESS_QOS_POLICY_ID deadline", "write sample  to topic", "it doesn't work", "WRITE_FAILED on publisher", "read data and take data, how to use",
)
_PROBED = f"text || ' ' || [{', '.join(repr(p) if chr(39) not in p else chr(39) + p.replace(chr(39), chr(39) * 2) + chr(39) for p in PROBES)}][(conv_id * 7 + turn) % {len(PROBES)} + 1]"
_BOUND = "(?:^|[^A-Za-z0-9_])({0})(?:$|[^A-Za-z0-9_])"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def analysis_ctes(asked: str) -> str:
    """The analysis in SQL, from the same tables of fixed values: common tables of which the last is ``f``.

    ``asked`` is SQL for rows with the one-spaced query ``o``.
    """
    entity = "{{'kind': {0}, 'surface': {1}, 'canonical': {2}}}".format
    found, added, tasks = [], [], []
    for short, names in analysis.ABBREVIATIONS.items():
        hit = f"regexp_matches(o, '(?i){_BOUND.format(short)}')"
        found.append(f"CASE WHEN {hit} THEN {entity(_quoted('abbreviation'), f'regexp_extract(o, {_quoted(chr(40) + chr(63) + chr(105) + chr(41) + _BOUND.format(short))}, 1)', _quoted(names[0]))} END")
        added.append(f"CASE WHEN {hit} THEN [{', '.join(map(_quoted, names))}] END")
    for pattern, names in analysis.ALIASES:
        hit, own = f"regexp_matches(o, {_quoted('(?i)' + pattern)})", list(names)
        surface = f"regexp_extract(o, {_quoted('(?i)' + pattern)})"
        found.append(f"CASE WHEN {hit} THEN {entity(_quoted('term'), surface, _quoted(own[0]))} END")
        added.append(f"CASE WHEN {hit} THEN [{', '.join(map(_quoted, own))}] END")
    for pattern, name in analysis.FUNCTIONS:
        hit = f"regexp_matches(o, {_quoted('(?i)' + pattern)})"
        found.append(f"CASE WHEN {hit} THEN {entity(_quoted('api'), 'o', _quoted(name))} END")
        tasks.append(f"CASE WHEN {hit} THEN [{_quoted(name)}] END")
    kind = f"CASE WHEN regexp_full_match(x, {_quoted(analysis.ERROR)}) THEN 'error_code' WHEN regexp_matches(x, {_quoted(analysis.ENUM)}) THEN 'enum' WHEN regexp_matches(x, {_quoted(analysis.STRUCTURE)}) THEN 'struct' ELSE 'api' END"
    explicit = f"list_transform(regexp_extract_all(o, {_quoted(analysis.IDENTIFIER)}), lambda x: {entity(kind, 'x', 'x')})"
    errors = f"list_transform(regexp_extract_all(o, {_quoted(analysis.ERROR)}), lambda x: {entity(_quoted('error_code'), 'x', 'x')})"
    flat = lambda parts: f"flatten(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))"
    scores = []
    for name, words, _ in analysis.INTENTS:
        score = " + ".join(f"contains(lower(o), {_quoted(w)})::INT" for w in words)
        extra = {"troubleshooting": " + CASE WHEN has_error THEN 3 ELSE 0 END", "api_usage": " + CASE WHEN has_api THEN 1 ELSE 0 END"}.get(name, "")
        scores.append(f"{score}{extra}")
    names = [name for name, _, _ in analysis.INTENTS]
    expansion = " ".join(f"WHEN {_quoted(n)} THEN {_quoted(('DDS ' if n in ('troubleshooting', 'installation', 'configuration') else '') + more)}" for n, _, more in analysis.INTENTS)
    focus = " ".join(f"WHEN len(list_filter(es, lambda e: contains(e.canonical, {_quoted(part)}))) > 0 THEN {_quoted(asks)}" for part, asks in analysis.FOCUS)
    return f"""q AS ({asked}),
a AS (SELECT *, list_concat(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL), {explicit}, {errors}) AS every, {flat(added + tasks)} AS added, list_distinct({flat(tasks)}) AS tasks FROM q),
b AS (SELECT *, list_filter(every, lambda e, i: list_position(list_transform(every, lambda x: x.kind || ':' || lower(x.canonical)), e.kind || ':' || lower(e.canonical)) = i) AS es,
  list_reduce(list_prepend(o, added), lambda s, x: CASE WHEN contains(lower(s), lower(x)) THEN s ELSE s || ' ' || x END) AS normalized FROM a),
c AS (SELECT *, len(list_filter(es, lambda e: e.kind = 'error_code')) > 0 AS has_error, len(list_filter(es, lambda e: e.kind IN ('api', 'struct', 'enum'))) > 0 AS has_api,
  array_to_string(list_transform(es, lambda e: e.canonical), ' ') AS all_names FROM b),
d AS (SELECT *, [{', '.join(scores)}] AS scores FROM c),
e AS (SELECT *, CASE WHEN list_max(scores) > 0 THEN [{', '.join(map(_quoted, names))}][list_position(scores, list_max(scores))] ELSE 'general' END AS intent,
  regexp_matches(o, {_quoted('(?i)' + analysis.VAGUE)}) AND len(list_filter(es, lambda e: e.kind IN ('api', 'error_code') AND e.surface = e.canonical)) = 0 AS ambiguous,
  CASE WHEN all_names = '' THEN 'DDS' ELSE array_to_string(list_filter(list_transform(es, lambda e: e.canonical), lambda x, i: list_position(list_transform(es, lambda e: e.canonical), x) = i), ' ') END AS names FROM d),
f AS (SELECT *, names || ' ' || CASE intent {expansion} ELSE {_quoted(analysis.GENERAL_EXPANSION)} END AS second,
  CASE WHEN len(tasks) > 0 THEN array_to_string(list_filter({flat(tasks)}, lambda x: TRUE), ' ') {focus} ELSE names || ' DDS 接口 结构体 枚举 错误码' END AS third
  FROM e)"""


_ANALYSIS_SQL = f"""WITH {analysis_ctes(f"SELECT conv_id, turn, trim(regexp_replace({_PROBED}, '\\s+', ' ', 'g')) AS o FROM conversations")}
SELECT conv_id, turn, intent, ambiguous, sha256(normalized) AS normalized_sha256, array_to_string(list_transform(es, lambda e: e.kind || '=' || e.canonical), ',') AS found,
  sha256(CASE WHEN NOT ambiguous THEN normalized ELSE normalized || '|' || second || CASE WHEN third = second THEN '' ELSE '|' || third END END) AS subqueries_sha256 FROM f"""
# The list of tasks inside of f is read again from o: it is spelt with the patterns, in order and without repeats.


@query(_ANALYSIS_SQL)
def query_analysis(spark, sf_dir):
    """Messages, each with wording of the domain after it: entities, normal form, intent, ambiguity and subqueries."""
    probe = F.element_at(F.array(*map(F.lit, PROBES)), ((F.col("conv_id") * 7 + F.col("turn")) % len(PROBES) + 1).cast("int"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(" ", "text", probe).alias("query"))
    a = analysis.analyzed(c)
    found = F.array_join(F.transform("entities", lambda e: F.concat_ws("=", e["kind"], e["canonical"])), ",")
    return a.select(
        "conv_id", "turn", "intent", "ambiguous", F.sha2("normalized", 256).alias("normalized_sha256"), found.alias("found"),
        F.sha2(F.array_join("subqueries", "|"), 256).alias("subqueries_sha256"),
    )


_CODE = """c AS (SELECT doc_id, lang, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x, i: CASE WHEN i % 3 = 2 THEN
  CASE lang WHEN 'en' THEN 'def f' || i || '(): # ' || x WHEN 'fr' THEN 'func (t *T) F' || i || '() { // ' || x WHEN 'de' THEN 'public final class C' || i || ' { // ' || x ELSE 'export async function f' || i || '() { // ' || x END ELSE '  ' || x END) AS l FROM documents)"""
_OPENERS = " ".join(f"WHEN '{lang}' THEN {_quoted(ingest.SYMBOLS[name])}" for lang, name in (("en", "python"), ("fr", "go"), ("de", "java"), ("es", "typescript")))


@query(f"""WITH {_CODE}, r AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS line, lang FROM c),
o AS (SELECT *, CASE lang {' '.join(f"WHEN '{lang}' THEN regexp_extract(line, {_quoted(ingest.SYMBOLS[name])}, 1)" for lang, name in (("en", "python"), ("fr", "go"), ("de", "java"), ("es", "typescript")))} END AS symbol FROM r),
s AS (SELECT *, sum(CASE WHEN symbol <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS section FROM o),
f AS (SELECT doc_id, section, max(nullif(symbol, '')) AS symbol, min(CASE WHEN trim(line) <> '' THEN idx END) AS a, max(CASE WHEN trim(line) <> '' THEN idx END) AS b FROM s GROUP BY 1, 2)
SELECT f.doc_id, f.symbol, CAST(a + 1 AS BIGINT) AS start_line, CAST(b + 1 AS BIGINT) AS end_line, sha256(string_agg(line, chr(10) ORDER BY idx)) AS text_sha256
FROM f JOIN s ON s.doc_id = f.doc_id AND s.section = f.section AND s.idx BETWEEN f.a AND f.b WHERE a IS NOT NULL GROUP BY f.doc_id, f.section, f.symbol, a, b""")
def code_sections(spark, sf_dir):
    """Sections of code by symbol: the documents' lines, of which every third becomes a declaration of its language."""
    lang = F.col("lang")
    lines = T.lines(F.col("text"))
    heads = {"en": ("def f", "(): # "), "fr": ("func (t *T) F", "() { // "), "de": ("public final class C", " { // ")}

    def line(x, i):
        number = (i + 1).cast("string")
        head = F.concat(F.lit("export async function f"), number, F.lit("() { // "), x)
        for key, (a, b) in heads.items():
            head = F.when(lang == key, F.concat(F.lit(a), number, F.lit(b), x)).otherwise(head)
        return F.when((i + 1) % 3 == 2, head).otherwise(F.concat(F.lit("  "), x))

    language = F.create_map(*[F.lit(x) for pair in (("en", "python"), ("fr", "go"), ("de", "java"), ("es", "typescript")) for x in pair])[lang]
    code = table(spark, sf_dir, "documents").select("doc_id", language.alias("language"), F.array_join(F.transform(lines, line), "\n").alias("text"))
    cut = ingest.code_sections(code)
    return cut.select("doc_id", F.col("title").alias("symbol"), "start_line", "end_line", F.sha2("text", 256).alias("text_sha256"))


_STEPS = """p AS (SELECT doc_id, lang, ordinal, CASE (doc_id + ordinal) % 6 WHEN 5 THEN content WHEN 0 THEN 'Step ' || (ordinal + 1) || ': ' || content WHEN 1 THEN '步骤 ' || (ordinal + 1) || '、' || content
  ELSE '第' || CASE WHEN ordinal < 10 THEN substr('一二三四五六七八九十', CAST(ordinal + 1 AS INT), 1) WHEN ordinal < 19 THEN '十' || substr('一二三四五六七八九', CAST(ordinal - 9 AS INT), 1) ELSE CAST(ordinal + 1 AS VARCHAR) END || '步 ' || content END AS text FROM lines)"""


@query(f"""WITH {LINES}, {_STEPS}, n AS (SELECT *, CASE WHEN (doc_id + ordinal) % 6 < 5 THEN ordinal + 1 END AS step FROM p),
b AS (SELECT *, CASE WHEN step IS NOT NULL AND lag(step) OVER w = step - 1 THEN 0 ELSE 1 END AS opens FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ordinal) AS run FROM b)
SELECT doc_id, min(ordinal) AS ordinal, min(step) AS first_step, max(step) AS last_step, count(*) AS segments, sha256(string_agg(trim(text), chr(10) || chr(10) ORDER BY ordinal)) AS text_sha256 FROM g GROUP BY doc_id, run""")
def procedures(spark, sf_dir):
    """Neighbouring numbered steps as one segment: the documents' lines, of which five of six are made steps."""
    lines = ingest.line_chunks(table(spark, sf_dir, "documents")).withColumn("ordinal", F.col("ordinal").cast("long"))
    n, kind = F.col("ordinal") + 1, (F.col("doc_id") + F.col("ordinal")) % 6
    numeral = F.when(n <= 10, F.substring(F.lit("一二三四五六七八九十"), n.cast("int"), F.lit(1))).when(n <= 19, F.concat(F.lit("十"), F.substring(F.lit("一二三四五六七八九"), (n - 10).cast("int"), F.lit(1)))).otherwise(n.cast("string"))
    text = (
        F.when(kind == 5, F.col("content"))
        .when(kind == 0, F.concat(F.lit("Step "), n.cast("string"), F.lit(": "), "content"))
        .when(kind == 1, F.concat(F.lit("步骤 "), n.cast("string"), F.lit("、"), "content"))
        .otherwise(F.concat(F.lit("第"), numeral, F.lit("步 "), "content"))
    )
    p = ingest.coalesced_procedures(lines.select("doc_id", "ordinal", F.col("lang").alias("scope"), F.lit("").alias("heading"), text.alias("text")))
    return p.select("doc_id", "ordinal", F.col("first_step").cast("long").alias("first_step"), F.col("last_step").cast("long").alias("last_step"), "segments", F.sha2("text", 256).alias("text_sha256"))


@query()
def page_topics(spark, sf_dir):
    """Pages as topics: blocks of the content under their headings, with the Markdown of each page."""
    blocks = topics.html_topics(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("content")))
    return blocks.select("page_id", "ordinal", "heading_path", "start_line", "end_line", "anchor", F.sha2("text", 256).alias("text_sha256"))


@query(r"""WITH t AS (SELECT page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS heading, page_id % 3 = 0 AS chi FROM pages),
w AS (SELECT *, CASE WHEN chi THEN concat_ws(chr(10), 'Index keyword: ' || nullif(title, ''), 'Topic: ' || nullif(heading, ''), 'Topic URL: ' || nullif(url, '')) ELSE concat_ws(chr(10), 'Topic: ' || nullif(title, ''), 'Heading: ' || nullif(heading, '')) END AS prefix FROM t)
SELECT page_id, sha256(CASE WHEN prefix = '' THEN 'body ' || page_id ELSE prefix || chr(10) || chr(10) || 'body ' || page_id END) AS weighted_sha256, 'body ' || page_id AS shown FROM w""")
def weighted_content(spark, sf_dir):
    """What is indexed of a topic (labels before its text), and what of that is shown again."""
    p = table(spark, sf_dir, "pages")
    title, heading = (F.trim(F.regexp_extract("html", f"<{t}>([^<]*)</{t}>", 1)) for t in ("title", "h1"))
    kind = F.when(F.col("page_id") % 3 == 0, "chi").otherwise("chm")
    labels = {"Index keyword": F.when(kind == "chi", title), "Topic": F.when(kind == "chi", heading).otherwise(title), "Heading": F.when(kind == "chm", heading), "Topic URL": F.when(kind == "chi", F.col("url"))}
    w = p.select("page_id", kind.alias("kind"), T.with_labels(labels, F.concat(F.lit("body "), F.col("page_id").cast("string"))).alias("weighted"))
    return w.select("page_id", F.sha2("weighted", 256).alias("weighted_sha256"), T.without_labels(F.col("weighted"), F.col("kind")).alias("shown"))


_CITED = "list_reduce(list_prepend('', list_transform(string_split(text, '. '), lambda s, i: s || ' [' || (length(s) % 9 + 1) || ']')), lambda a, b: CASE WHEN a = '' THEN b ELSE a || '. ' || b END)"


@query(f"""WITH a AS (SELECT doc_id, {_CITED} AS answer FROM documents),
m AS (SELECT doc_id, unnest(range(len(c))) AS pos, CAST(unnest(c) AS BIGINT) AS cited FROM (SELECT doc_id, regexp_extract_all(answer, '\\[(\\d+)\\]', 1) AS c FROM a)),
f AS (SELECT doc_id, cited, min(pos) AS first FROM m GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS number FROM f)
SELECT doc_id, max(cited) <= 8 AS valid, CASE WHEN max(cited) <= 8 THEN string_agg(CAST(cited AS VARCHAR), ',' ORDER BY number) END AS sources FROM n GROUP BY 1""")
def citations(spark, sf_dir):
    """Citations ``[n]`` of answers with eight pieces of evidence: valid or not, and the evidence by first appearance."""
    parts = F.transform(F.split("text", r"\. "), lambda s: F.concat(s, F.lit(" ["), (F.length(s) % 9 + 1).cast("string"), F.lit("]")))
    answers = table(spark, sf_dir, "documents").select("doc_id", F.array_join(parts, ". ").alias("answer"))
    return answers.select("doc_id", *T.renumbered(F.col("answer"), F.lit(8))).select("doc_id", "valid", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


@query("""WITH a AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS k FROM conversations)
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) > 1 AS attempted FROM a""")
def attempted_queries(spark, sf_dir):
    """Whether a conversation has asked the same before, in any case and spacing."""
    key = analysis.wire_search_terms(F.col("text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", key.alias("key"))
    return c.select("conv_id", "turn", (F.row_number().over(W.partitionBy("conv_id", "key").orderBy("turn")) > 1).alias("attempted"))
