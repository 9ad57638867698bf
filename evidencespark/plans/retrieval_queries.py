"""The full retrieval plan over passages of the documents, and stages of it, each beside SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidencespark.functions import text as T
from evidencespark.operators import lifecycle, retrieval
from evidencespark.plans.queries import TERMS, VECTOR, WORDS, query
from evidencespark.plans.text_queries import PROBES, analysis_ctes
from evidencespark.sources.shared import stored
from evidencespark.sources.tables import table

#: Names that some passages carry as their symbol, so that queries can name one.
SYMBOLS = ("DDS_LIVELINESS_QOS_POLICY_ID", "dds_retcode_timeout", "WRITE_FAILED", "DDS_DataReaderQos")
TOP_K, BUDGET = 6, 1500
_SIZE = 1 << 24


def _chunks(spark, sf_dir):
    """Passages of four lines. English texts stand for help files, whose topics are three passages each, French ones for
    keyword indexes that name topics of the help file of their source, German ones for PDF files, others for texts.

    Each is indexed as version 1; see :func:`_active`.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", T.lines(F.col("text")).alias("lines"))
    n = F.ceil(F.size("lines") / 4).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice("lines", i * 4 + 1, F.lit(4)), "\n"))
    d = d.where(F.size("lines") > 0).select("doc_id", "lang", "source", F.posexplode(cut).alias("ordinal", "text"))
    kind = F.when(F.col("lang") == "en", "chm").when(F.col("lang") == "fr", "chi").when(F.col("lang") == "de", "pdf").otherwise("text")
    topic = F.concat(F.lit("t"), (F.col("doc_id") % 10).cast("string"), F.lit("/"), F.floor(F.col("ordinal") / 3).cast("string"), F.lit(".html"))
    d = d.withColumns({"source_type": kind, "ordinal": F.col("ordinal").cast("long")})
    topical = F.col("source_type").isin("chm", "chi")
    return d.select(
        (F.col("doc_id") * _SIZE + F.col("ordinal")).alias("record_id"), "doc_id", F.lit(1).cast("long").alias("version"), "ordinal", "text",
        F.concat("source", F.lit("."), "source_type").alias("source_name"), "source_type",
        F.when(topical, topic).alias("topic_path"), F.col("source").alias("topic_title"), F.when(topical, F.concat(F.lit("/"), topic)).alias("topic_url"),
        F.get(F.array(*map(F.lit, SYMBOLS)), (F.col("doc_id") % 9).cast("int")).alias("symbol"),
        F.when(F.col("source_type") == "chi", F.concat("source", F.lit(".chm"))).alias("associated_source"),
        F.when(topical, F.concat(F.lit("a"), (F.col("ordinal") % 2).cast("string"))).alias("anchor"), T.digest_vector(F.col("text")).alias("vector"),
    )


def _active(spark, sf_dir):
    """Documents with an id divisible by 7 have a finished second version, those by 5 an unfinished one, those by 11 none."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    first = ids.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("document_id"), F.lit(1).cast("long").alias("version"), F.lit(True).alias("finished"))
    second = ids.where("doc_id % 7 = 0 OR doc_id % 5 = 0").select(F.col("doc_id").alias("document_id"), F.lit(2).cast("long").alias("version"), (F.col("doc_id") % 7 == 0).alias("finished"))
    return lifecycle.active_versions(first.unionByName(second))


def _queries(spark, sf_dir):
    """Passages of ``benchmark``; half of them have wording of the domain after them."""
    probe = F.element_at(F.array(*map(F.lit, PROBES)), (F.col("item_id") % len(PROBES) + 1).cast("int"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 1, F.concat_ws(" ", "text", probe)).otherwise(F.col("text")).alias("query"))


def _retrieved(spark, sf_dir):
    chunks = stored(_chunks(spark, sf_dir), "chunks")
    return retrieval.retrieve(chunks, _queries(spark, sf_dir), stored(_active(spark, sf_dir), "active"), retrieval.Settings(TOP_K, BUDGET))


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_LIST = ", ".join
_PROBED = f"CASE WHEN item_id % 2 = 1 THEN text || ' ' || [{_LIST(map(_text, PROBES))}][item_id % {len(PROBES)} + 1] ELSE text END"
_ASKED = f"SELECT item_id AS query_id, {_PROBED} AS query, trim(regexp_replace({_PROBED}, '\\s+', ' ', 'g')) AS o FROM benchmark"
_ROUTES = f"""{analysis_ctes(_ASKED)},
dl AS (SELECT doc_id, source, CASE lang WHEN 'en' THEN 'chm' WHEN 'fr' THEN 'chi' WHEN 'de' THEN 'pdf' ELSE 'text' END AS source_type, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
dn AS (SELECT *, unnest(range((len(l) + 3) // 4)) AS ordinal FROM dl),
ch AS (SELECT doc_id * {_SIZE} + ordinal AS record_id, doc_id, ordinal, source_type, array_to_string(l[ordinal * 4 + 1 : ordinal * 4 + 4], chr(10)) AS text, source || '.' || source_type AS source_name,
  CASE WHEN source_type IN ('chm', 'chi') THEN 't' || doc_id % 10 || '/' || ordinal // 3 || '.html' END AS topic, source AS title, [{_LIST(map(_text, SYMBOLS))}][doc_id % 9 + 1] AS symbol,
  CASE WHEN source_type = 'chi' THEN source || '.chm' END AS associated, ordinal % 2 AS anchor, doc_id % 11 <> 0 AND doc_id % 7 <> 0 AS visible FROM dn),
sub AS (SELECT query_id, unnest(range(len(s))) AS subquery, unnest(s) AS text FROM (SELECT query_id, CASE WHEN NOT ambiguous THEN [normalized] WHEN third = second THEN [normalized, second] ELSE [normalized, second, third] END AS s FROM f)),
dv AS (SELECT record_id, {VECTOR.format("text")} AS v FROM ch), qv AS (SELECT query_id, subquery, {VECTOR.format("text")} AS v FROM sub),
dense AS (SELECT query_id, subquery, record_id, round(list_cosine_similarity(qv.v, dv.v), 9) AS score FROM dv, qv QUALIFY row_number() OVER (PARTITION BY query_id, subquery ORDER BY score DESC, record_id) <= 24),
pt AS (SELECT record_id, {TERMS.format("text")} AS terms FROM ch), stats AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_length FROM pt),
p AS (SELECT record_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT record_id, len(terms) AS length, unnest(terms) AS term FROM pt) GROUP BY 1, 2),
qt AS (SELECT DISTINCT query_id, subquery, unnest({TERMS.format("text")}) AS term FROM sub),
df AS (SELECT term, ln(1 + (max(n_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, stats GROUP BY 1),
bm AS (SELECT query_id, subquery, record_id, round(sum(idf * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length))), 6) AS score FROM p JOIN df USING (term) JOIN qt USING (term), stats GROUP BY 1, 2, 3),
ph AS (SELECT sub.query_id, sub.subquery, record_id, (length(c) - length(replace(c, w, ''))) // length(w) AS pf, n AS length
  FROM (SELECT record_id, len(terms) AS n, ' ' || array_to_string(terms, '  ') || ' ' AS c FROM pt) t, (SELECT query_id, subquery, ' ' || array_to_string({TERMS.format("text")}, '  ') || ' ' AS w FROM sub) sub WHERE w <> '  ' AND contains(c, w)),
bonus AS (SELECT query_id, subquery, record_id, round(10 * idf * pf / (pf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length)), 6) AS bonus FROM ph JOIN (SELECT query_id, subquery, sum(idf) AS idf FROM qt JOIN df USING (term) GROUP BY 1, 2) USING (query_id, subquery), stats),
sparse AS (SELECT query_id, subquery, record_id, round(score + coalesce(bonus, 0), 6) AS score FROM bm LEFT JOIN bonus USING (query_id, subquery, record_id) QUALIFY row_number() OVER (PARTITION BY query_id, subquery ORDER BY round(score + coalesce(bonus, 0), 6) DESC, record_id) <= 24),
ro AS (SELECT r.*, row_number() OVER (PARTITION BY kind, query_id, subquery ORDER BY score DESC, record_id) AS rank FROM (SELECT 0 AS kind, * FROM dense UNION ALL SELECT 1, * FROM sparse) r JOIN ch USING (record_id) WHERE visible),
mr AS (SELECT kind, query_id, record_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s, min(rank) AS best FROM ro GROUP BY 1, 2, 3),
mk AS (SELECT *, row_number() OVER (PARTITION BY kind, query_id ORDER BY s DESC, best, record_id) AS rank FROM mr),
fu AS (SELECT query_id, record_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fusion_score FROM mk GROUP BY 1, 2),
fx AS (SELECT fu.*, q.query, f.intent, ch.* EXCLUDE (record_id), list_distinct(list_transform(list_filter(regexp_extract_all(f.normalized, '\\b[A-Za-z][A-Za-z0-9_]{{4,}}\\b'), lambda x: contains(x, '_')), lambda x: lower(x))) AS ids,
  lower(concat_ws(chr(10), ch.text, coalesce(symbol, ''), title, coalesce('/' || topic, ''))) AS body FROM fu JOIN ch USING (record_id) JOIN f USING (query_id) JOIN q USING (query_id)),
fy AS (SELECT *, CAST(coalesce(list_sum(list_transform(ids, lambda x: (lower(coalesce(symbol, '')) = x)::INT + (lower(title) = x)::INT + (lower(coalesce('/' || topic, '')) = x)::INT)), 0) AS BIGINT) AS exact,
  CAST(coalesce(list_sum(list_transform(ids, lambda x: (length(body) - length(replace(body, x, ''))) // length(x))), 0) AS BIGINT) AS occurrences FROM fx),
fz AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, occurrences DESC, fusion_score DESC, record_id) AS first FROM fy),
re AS (SELECT *, round(CAST(len(list_intersect({WORDS.format("query")}, {WORDS.format("text")})) AS DOUBLE) / greatest(len({WORDS.format("query")}), 1), 9) AS rerank_score FROM fz WHERE first <= 20),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, fusion_score DESC, record_id) AS rank FROM re)"""
_PLACES = """u1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, sha256(text) ORDER BY rank) AS nth FROM rk),
u2 AS (SELECT *, coalesce(topic <> '', FALSE) AND row_number() OVER (PARTITION BY query_id, lower(topic) ORDER BY rank) > 1 AS deferred FROM u1 WHERE nth = 1),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY deferred, rank) AS pos, source_type = 'pdf' AND intent IN ('general', 'installation', 'configuration', 'troubleshooting', 'performance_tuning') AS wanted FROM u2),
pn AS (SELECT *, pos <= 6 AS inside, row_number() OVER (PARTITION BY query_id, pos <= 6, wanted ORDER BY pos) AS nth_in, row_number() OVER (PARTITION BY query_id, pos <= 6, wanted ORDER BY pos DESC) AS nth_out,
  greatest(least(2 - count(*) FILTER (pos <= 6 AND wanted) OVER w, count(*) FILTER (pos > 6 AND wanted) OVER w, count(*) FILTER (pos <= 6 AND NOT wanted) OVER w), 0) AS swaps FROM pool WINDOW w AS (PARTITION BY query_id)),
an AS (SELECT query_id, record_id, pos AS place FROM pn WHERE inside AND NOT (NOT wanted AND nth_out <= swaps)
  UNION ALL SELECT n.query_id, n.record_id, o.pos FROM pn n JOIN pn o ON o.query_id = n.query_id AND o.inside AND NOT o.wanted AND o.nth_out <= o.swaps AND o.nth_out = n.nth_in WHERE NOT n.inside AND n.wanted AND n.nth_in <= n.swaps),
ac AS (SELECT an.*, ch.* EXCLUDE (record_id) FROM an JOIN ch USING (record_id)),
rc AS (SELECT a.query_id, a.place, c.record_id, c.ordinal, 1 + 4 * coalesce(bm.score, 0) + 12 * coalesce(bonus.bonus, 0) / 10 + CASE WHEN a.anchor = c.anchor THEN 25 ELSE 0 END AS hint
  FROM ac a JOIN ch c ON a.source_type = 'chi' AND c.source_type = 'chm' AND c.visible AND c.source_name = a.associated AND c.topic = a.topic
  LEFT JOIN bm ON bm.query_id = a.query_id AND bm.subquery = 0 AND bm.record_id = c.record_id LEFT JOIN bonus ON bonus.query_id = a.query_id AND bonus.subquery = 0 AND bonus.record_id = c.record_id),
rt AS (SELECT query_id, record_id, ordinal, round(sum(hint), 5) AS total FROM rc GROUP BY 1, 2, 3),
rn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, ordinal, record_id) AS nth FROM rt),
rl AS (SELECT rn.* FROM rn JOIN (SELECT query_id, least(count(*) * 12, 100) AS most FROM ac WHERE source_type = 'chi' GROUP BY 1) USING (query_id) WHERE nth <= most),
rf AS (SELECT rc.query_id, rc.place, arg_min(rc.record_id, rl.nth) AS record_id FROM rc JOIN rl USING (query_id, record_id) GROUP BY 1, 2),
r1 AS (SELECT query_id, record_id, min(place) AS named FROM rf GROUP BY 1, 2)"""
_EVIDENCE = f"""li AS (SELECT a.query_id, a.record_id, a.place, 0 AS kind, CASE WHEN a.source_type <> 'chi' THEN e.record_id END AS cause FROM ac a LEFT JOIN r1 ON r1.query_id = a.query_id AND r1.record_id = a.record_id LEFT JOIN an e ON e.query_id = a.query_id AND e.place = r1.named
  UNION ALL SELECT r1.query_id, r1.record_id, r1.named, 1, e.record_id FROM r1 JOIN an e ON e.query_id = r1.query_id AND e.place = r1.named WHERE NOT EXISTS (SELECT 1 FROM an x WHERE x.query_id = r1.query_id AND x.record_id = r1.record_id)),
lp AS (SELECT li.*, ch.doc_id, ch.ordinal, ch.source_type, ch.topic, row_number() OVER (PARTITION BY li.query_id ORDER BY place, kind, li.record_id) AS pos FROM li JOIN ch USING (record_id)),
nb AS (SELECT lp.query_id, lp.pos, lp.record_id AS src, c.record_id, c.ordinal - lp.ordinal AS distance, c.ordinal FROM lp JOIN ch c ON lp.source_type = 'chm' AND c.doc_id = lp.doc_id AND c.topic = lp.topic AND abs(c.ordinal - lp.ordinal) = 1
  WHERE NOT EXISTS (SELECT 1 FROM lp x WHERE x.query_id = lp.query_id AND x.record_id = c.record_id) QUALIFY row_number() OVER (PARTITION BY lp.query_id, c.record_id ORDER BY lp.pos, abs(c.ordinal - lp.ordinal), c.ordinal - lp.ordinal) = 1),
al AS (SELECT query_id, record_id, pos, 0 AS distance, ordinal, CASE kind WHEN 1 THEN 'reference' ELSE 'anchor' END AS role, cause FROM lp UNION ALL SELECT query_id, record_id, pos, distance, ordinal, 'neighbour', src FROM nb),
ev AS (SELECT al.*, row_number() OVER (PARTITION BY query_id ORDER BY distance <> 0, pos, abs(distance), al.ordinal) AS position, (length(ch.text) + 3) // 4 AS tokens FROM al JOIN ch USING (record_id)),
walk AS (SELECT query_id, 0::BIGINT AS position, 0::BIGINT AS used, FALSE AS selected FROM (SELECT DISTINCT query_id FROM ev)
  UNION ALL SELECT w.query_id, ev.position, CASE WHEN w.used + ev.tokens <= {BUDGET} THEN w.used + ev.tokens ELSE w.used END, w.used + ev.tokens <= {BUDGET} FROM walk w JOIN ev ON ev.query_id = w.query_id AND ev.position = w.position + 1)"""


@query(f"""WITH RECURSIVE {_ROUTES}, {_PLACES}, {_EVIDENCE}
SELECT ev.query_id, ev.position, ev.record_id, ev.role, ev.cause, CAST(ev.distance AS BIGINT) AS distance, rk.fusion_score, rk.rerank_score, CAST(ev.tokens AS BIGINT) AS tokens, walk.selected
FROM ev JOIN walk USING (query_id, position) LEFT JOIN rk ON rk.query_id = ev.query_id AND rk.record_id = ev.record_id AND ev.role = 'anchor'""")
def retrieve_plan(spark, sf_dir):
    """The evidence of every query: anchors, references of index entries, neighbours in topics, and what fits the budget."""
    return _retrieved(spark, sf_dir).evidence.select("query_id", "position", "record_id", "role", "cause", "distance", "fusion_score", "rerank_score", "tokens", "selected")


@query(f"WITH {_ROUTES} SELECT query_id, record_id, exact, occurrences, rerank_score, rank FROM rk")
def retrieve_ranked(spark, sf_dir):
    """The candidates of every query that are reranked: after both routes, visibility, fusion and identifiers."""
    return _retrieved(spark, sf_dir).ranked.select("query_id", "record_id", "exact", "occurrences", "rerank_score", "rank")


@query(f"WITH {_ROUTES}, {_PLACES} SELECT query_id, record_id, place FROM an")
def retrieve_anchors(spark, sf_dir):
    """Six anchors of every query, diverse, with a third for narrative files where the intent asks for them."""
    return _retrieved(spark, sf_dir).anchors.select("query_id", "record_id", "place")
