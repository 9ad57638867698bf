"""The registered queries of the engine, each beside DuckDB SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidencespark.functions import text as T
from evidencespark.operators import fuse, ingest, lifecycle, nearest, search
from evidencespark.sources.shared import stored
from evidencespark.sources.tables import table
from evidencespark.streaming import tasks

#: Most best pages (one for each language and slot) that are broadcast to the documents.
BEST_PAGES = 50_000
#: Most ranked rows that are broadcast to the documents.
CANDIDATES = 200_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Common relations of the SQL texts.
LINES = """lines AS (
  SELECT doc_id, source, lang, CAST(unnest(range(len(l))) AS BIGINT) AS ordinal, unnest(l) AS content
  FROM (SELECT doc_id, source, lang, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents))"""
WORDS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[ \t\n\r\f\x0B]+'), lambda w: w <> ''))"
TERMS = "regexp_extract_all(lower({0}), '[a-z0-9_à-öø-ÿœß]+|[一-鿿]')"
OVERLAP = f"""asked AS (SELECT item_id AS query_id, len(w) AS n, unnest(w) AS word FROM (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark)),
held AS (SELECT doc_id AS record_id, unnest({WORDS.format("text")}) AS word FROM documents),
hits AS (SELECT query_id, record_id, round(CAST(count(*) AS DOUBLE) / max(n), 9) AS score FROM held JOIN asked USING (word) GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM hits) WHERE rank <= 20)"""
BM25 = f"""t AS (SELECT doc_id AS record_id, {TERMS.format("text")} AS terms FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_length FROM t),
p AS (SELECT record_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT record_id, len(terms) AS length, unnest(terms) AS term FROM t) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format("text")}) AS term FROM benchmark),
s AS (SELECT query_id, record_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length))), 6) AS score
  FROM p JOIN df USING (term) JOIN q USING (term), stats GROUP BY 1, 2),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM s) WHERE rank <= 20)"""
PHRASED = """i AS (SELECT query_id, sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) AS idf FROM q JOIN df USING (term), stats GROUP BY 1),
w AS (SELECT item_id AS query_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9_à-öø-ÿœß]+|[一-鿿]'), '  ') || ' ' AS w FROM benchmark),
h AS (SELECT w.query_id, t.record_id, (length(c) - length(replace(c, w, ''))) // length(w) AS pf, len(terms) AS length
  FROM (SELECT record_id, terms, ' ' || array_to_string(terms, '  ') || ' ' AS c FROM t) t, w WHERE w <> '  ' AND contains(c, w)),
b AS (SELECT h.query_id, h.record_id, round(10 * idf * pf / (pf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length)), 6) AS bonus FROM h JOIN i USING (query_id), stats),
phrased AS (SELECT * FROM (SELECT query_id, record_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank
  FROM (SELECT s.query_id, s.record_id, round(s.score + coalesce(bonus, 0), 6) AS score FROM s LEFT JOIN b ON b.query_id = s.query_id AND b.record_id = s.record_id)) WHERE rank <= 20)"""
VECTOR = "[{0}]".format(", ".join(f"(('0x' || substr(sha256({{0}}), {2 * i + 1}, 2))::INT - 127.5::DOUBLE) / 127.5::DOUBLE" for i in range(8)))
DENSE = f"""dv AS (SELECT doc_id AS record_id, {VECTOR.format("text")} AS v FROM documents),
qv AS (SELECT item_id AS query_id, {VECTOR.format("text")} AS v FROM benchmark),
ds AS (SELECT query_id, record_id, round(list_cosine_similarity(qv.v, dv.v), 9) AS score FROM dv, qv),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM ds) WHERE rank <= 20)"""
RRF = """best AS (SELECT query_id, record_id, 0 AS route, rank FROM dense UNION ALL SELECT query_id, record_id, 1, rank FROM sparse),
fused0 AS (SELECT query_id, record_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fusion_score FROM best GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, record_id) AS rank FROM fused0)"""
DIVERSE = """c AS (SELECT f.*, sha256(d.text) AS content_sha256, d.source AS topic, d.lang FROM fused f JOIN documents d ON d.doc_id = f.record_id),
c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, content_sha256 ORDER BY rank) AS nth FROM c) WHERE nth = 1),
c2 AS (SELECT *, coalesce(trim(topic) <> '', FALSE) AND row_number() OVER (PARTITION BY query_id, lower(trim(topic)) ORDER BY rank) > 1 AS deferred FROM c1),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY deferred, rank) AS pos FROM c2)"""
STEP_BUDGET = """r AS (SELECT query_id, pos, record_id, tokens FROM ev),
walk AS (
  SELECT query_id, 0::BIGINT AS pos, 0::BIGINT AS used, '' AS selected, 0::BIGINT AS taken FROM (SELECT DISTINCT query_id FROM r)
  UNION ALL
  SELECT w.query_id, r.pos, CASE WHEN w.used + r.tokens <= {budget} THEN w.used + r.tokens ELSE w.used END,
    CASE WHEN w.used + r.tokens <= {budget} THEN CASE WHEN w.selected = '' THEN '' ELSE w.selected || ',' END || r.record_id ELSE w.selected END,
    CASE WHEN w.used + r.tokens <= {budget} THEN w.taken + 1 ELSE w.taken END
  FROM walk w JOIN r ON r.query_id = w.query_id AND r.pos = w.pos + 1),
done AS (SELECT query_id, max(pos) AS pos FROM walk GROUP BY 1)
SELECT w.query_id, selected, CAST(used AS BIGINT) AS estimated_tokens, CAST(w.pos - taken AS BIGINT) AS n_omitted FROM walk w JOIN done USING (query_id, pos)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text", "source", "lang")


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# --- ingest -------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT doc_id, ordinal, sha256(content) AS content_sha256, CAST((length(content) + 3) // 4 AS BIGINT) AS tokens FROM lines")
def chunk_lines(spark, sf_dir):
    return ingest.line_chunks(table(spark, sf_dir, "documents")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), "content_sha256", "tokens")


@query(f"WITH {LINES} SELECT doc_id, sha256(content) AS content_sha256, min(ordinal) AS ordinal, max(ordinal) AS last_ordinal, count(*) AS copies FROM lines GROUP BY 1, 2")
def chunk_collapse(spark, sf_dir):
    return ingest.collapsed(ingest.line_chunks(table(spark, sf_dir, "documents")))


@query("SELECT source, count(*) AS docs, CAST(sum((length(text) + 3) // 4) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def token_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query(r"""WITH l AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)) AS l FROM documents),
m AS (SELECT doc_id, l, list_transform(l, lambda x: regexp_matches(x, '([.．·・…]{4,}|\.{6,})\s*\|?\s*([ivxlcdm]{1,6}|\d{1,4})\s*\|?\s*$')) AS hit FROM l)
SELECT doc_id, list_contains(hit, TRUE) AND len(list_filter(list_zip(l, hit), lambda z: NOT z[2] AND length(z[1]) > 40)) = 0 AS is_index,
  CAST(len(l) AS BIGINT) AS n_lines FROM m""")
def noise_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.is_navigation_index(F.col("text")).alias("is_index"), F.size(T.lines(F.col("text"))).cast("long").alias("n_lines"))


@query("SELECT doc_id, sha256(text) AS content_sha256, doc_id || ':1:' || substr(sha256(text), 1, 16) AS record_id, substr(sha256(text), 1, 16) AS fingerprint, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def content_digest(spark, sf_dir):
    digest = F.sha2("text", 256)
    short = F.substring(digest, 1, 16)
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digest.alias("content_sha256"), T.record_id(F.col("doc_id"), F.lit(1), short).alias("record_id"), short.alias("fingerprint"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""SELECT doc_id, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS config_digest FROM documents""")
def config_digest(spark, sf_dir):
    keys = F.to_json(F.struct("lang", "n_chars", "source"), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(keys, 256).alias("config_digest"))


@query("SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS valid FROM embeddings")
def vector_validity(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", T.valid_vector(F.col("embedding"), 64).alias("valid"))


@query()
def recursive_chunks(spark, sf_dir):
    chunks = ingest.recursive_chunks(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "ordinal", "start_line", "end_line", "chunk_id", F.length("content").cast("long").alias("n_chars"))


@query(r"""WITH r AS (SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z][^ ]* [a-z]+\.$|^#{1,6}\s+(.*)$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS section FROM r),
f AS (SELECT doc_id, section, min(CASE WHEN trim(line) <> '' THEN idx END) AS a, max(CASE WHEN trim(line) <> '' THEN idx END) AS b FROM s GROUP BY 1, 2)
SELECT f.doc_id, CAST(a + 1 AS BIGINT) AS start_line, CAST(b + 1 AS BIGINT) AS end_line, sha256(string_agg(line, chr(10) ORDER BY idx)) AS text_sha256
FROM f JOIN s ON s.doc_id = f.doc_id AND s.section = f.section AND s.idx BETWEEN f.a AND f.b WHERE a IS NOT NULL GROUP BY f.doc_id, f.section, a, b""")
def markdown_sections(spark, sf_dir):
    """Sections of the documents; two-word lines open one too, as these texts have few headings."""
    cut = ingest.sections(table(spark, sf_dir, "documents"), r"^[A-Z][^ ]* [a-z]+\.$|^#{1,6}\s+(.*)$")
    return cut.select("doc_id", "start_line", "end_line", F.sha2("text", 256).alias("text_sha256"))


# --- search -------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS record_id, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 9) AS score FROM embeddings e, q)
SELECT query_id, record_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM s) WHERE rank <= 20""")
def dense_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"))
    asked = e.where("record_id % 20 = 0").withColumnRenamed("record_id", "query_id")
    return search.dense_topk(e, asked).withColumn("score", F.round("score", 6))


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS record_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS score FROM embeddings e JOIN embeddings q ON q.vec_id <> e.vec_id)
SELECT query_id, record_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS rank FROM s) WHERE rank <= 5""")
def nearest_lists_topk(spark, sf_dir):
    """The five nearest neighbours of every vector, from lists around centres whose bounds lose none."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("vector"))
    found = nearest.nearest(e, e.withColumnRenamed("record_id", "query_id"), 5, exclude_self=True)
    return search.top_k(found, 5).withColumn("score", F.round("score", 6))


@query(f"WITH {OVERLAP} SELECT * FROM sparse")
def sparse_overlap_topk(spark, sf_dir):
    return search.overlap_topk(_docs(spark, sf_dir), _asked(spark, sf_dir))


@query(f"WITH {BM25} SELECT * FROM bm25")
def bm25_topk(spark, sf_dir):
    return search.bm25_topk(_docs(spark, sf_dir), _asked(spark, sf_dir))


@query(f"WITH {BM25}, {PHRASED} SELECT * FROM phrased")
def bm25_phrase_topk(spark, sf_dir):
    """BM25 with a weight of 10 on texts that hold the whole query as a phrase."""
    return search.bm25_topk(_docs(spark, sf_dir), _asked(spark, sf_dir), phrase_boost=10.0)


@query(f"""WITH d AS (SELECT doc_id AS record_id, ' ' || array_to_string({TERMS.format("text")}, ' ') || ' ' AS t FROM documents),
q AS (SELECT item_id AS query_id, ' ' || array_to_string({TERMS.format("text")}, ' ') || ' ' AS w FROM benchmark)
SELECT query_id, record_id FROM d, q WHERE w <> '  ' AND contains(t, w)""")
def phrase_match(spark, sf_dir):
    return search.phrase_hits(_docs(spark, sf_dir), _asked(spark, sf_dir)).select("query_id", "record_id")


@query(f"WITH {OVERLAP}, {DENSE}, {RRF} SELECT query_id, record_id, fusion_score, rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir)


def _routes(spark, sf_dir):
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    vectors = stored(docs.select("record_id", T.digest_vector(F.col("text")).alias("vector")), "vectors")  # the texts are hashed once
    dense = search.dense_topk(vectors, asked.select("query_id", T.digest_vector(F.col("query")).alias("vector")))
    return dense, search.overlap_topk(docs, asked)


def _fused(spark, sf_dir):
    dense, sparse = _routes(spark, sf_dir)
    return fuse.rrf([(dense, 1.0), (sparse, 1.0)])


@query(f"""WITH {OVERLAP}, {BM25}, h AS (SELECT query_id, 0 AS subquery, record_id, rank, score FROM sparse UNION ALL SELECT query_id, 1, record_id, rank, score FROM bm25),
m AS (SELECT query_id, record_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rank_score, min(rank) AS best_rank, max(score) AS score FROM h GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, best_rank, record_id) AS rank FROM m""")
def route_merge(spark, sf_dir):
    docs, asked = _docs(spark, sf_dir), _asked(spark, sf_dir)
    a, b = search.overlap_topk(docs, asked), search.bm25_topk(docs, asked)
    return fuse.merge_routes(a.withColumn("subquery", F.lit(0)).unionByName(b.withColumn("subquery", F.lit(1))))


@query(f"""WITH {OVERLAP}, {DENSE}, {RRF}, top AS (SELECT * FROM fused WHERE rank <= 20),
x AS (SELECT top.query_id, top.record_id, fusion_score, CASE WHEN length(d.text) % 5 = 0 THEN NULL ELSE
  round(CAST(len(list_intersect({WORDS.format("b.text")}, {WORDS.format("d.text")})) AS DOUBLE) / greatest(len({WORDS.format("b.text")}), 1), 9) END AS rerank_score
  FROM top JOIN documents d ON d.doc_id = record_id JOIN benchmark b ON b.item_id = query_id)
SELECT * FROM (SELECT query_id, record_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, fusion_score DESC, record_id) AS rank FROM x) WHERE rank <= 6""")
def rerank_order(spark, sf_dir):
    """Rerank by word overlap; every fifth length has no score, as when a reranker gives up."""
    c = _with_text(spark, sf_dir, _fused(spark, sf_dir).where("rank <= 20"))
    share = F.size(F.array_intersect(T.words(F.col("query")), T.words(F.col("text")))) / F.greatest(F.size(T.words(F.col("query"))), F.lit(1))
    c = c.drop("rank").withColumn("rerank_score", F.when(F.length("text") % 5 != 0, F.round(share, 9)))
    return fuse.rerank(c, 6).select("query_id", "record_id", "rerank_score", "rank")


def _with_docs(spark, sf_dir, ranked):
    """``ranked`` with the columns of their documents; few rows go to the documents, many are joined by a shuffle."""
    ranked = stored(ranked, "ranked")
    few = ranked.limit(CANDIDATES + 1).count() <= CANDIDATES
    return _docs(spark, sf_dir).join(F.broadcast(ranked) if few else ranked, "record_id")


def _with_text(spark, sf_dir, ranked):
    return _with_docs(spark, sf_dir, ranked).join(_asked(spark, sf_dir), "query_id")


@query(f"""WITH {OVERLAP}, {DENSE}, {RRF},
x AS (SELECT f.query_id, f.record_id, fusion_score, list_filter(list_distinct(regexp_extract_all(lower(b.text || ' ' || d.source || '_id'), '[a-z][a-z0-9_]{{4,}}')), lambda t: contains(t, '_')) AS ids, lower(d.text || ' ' || d.source || '_id') AS body
  FROM fused f JOIN documents d ON d.doc_id = f.record_id JOIN benchmark b ON b.item_id = f.query_id),
y AS (SELECT query_id, record_id, fusion_score, CAST(coalesce(list_sum(list_transform(ids, lambda t: (length(body) - length(replace(body, t, ''))) // length(t))), 0) AS BIGINT) AS occurrences FROM x)
SELECT query_id, record_id, occurrences, row_number() OVER (PARTITION BY query_id ORDER BY occurrences DESC, fusion_score DESC, record_id) AS rank FROM y""")
def identifier_priority(spark, sf_dir):
    """Queries and texts get an identifier of the source, as these texts have none."""
    c = _with_text(spark, sf_dir, _fused(spark, sf_dir).drop("rank"))
    tag = F.concat(F.lit(" "), F.col("source"), F.lit("_id"))
    c = c.withColumns({"query": F.concat("query", tag), "text": F.concat("text", tag)})
    return fuse.by_identifier(c).select("query_id", "record_id", "occurrences", "rank")


@query(f"WITH {OVERLAP}, {DENSE}, {RRF}, {DIVERSE} SELECT query_id, record_id, deferred, pos FROM pool")
def diversify(spark, sf_dir):
    return _pool(spark, sf_dir).select("query_id", "record_id", "deferred", "pos")


def _pool(spark, sf_dir):
    c = _with_docs(spark, sf_dir, _fused(spark, sf_dir))
    return fuse.diversified(c.withColumns({"content_sha256": F.sha2("text", 256), "topic": F.col("source")}))


@query(f"""WITH {OVERLAP}, {DENSE}, {RRF}, {DIVERSE},
p AS (SELECT query_id, record_id, pos, lang = 'de' AS wanted, pos <= 6 AS inside FROM pool),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, inside, wanted ORDER BY pos) AS nth_in, row_number() OVER (PARTITION BY query_id, inside, wanted ORDER BY pos DESC) AS nth_out,
  greatest(least(2 - count(*) FILTER (inside AND wanted) OVER w, count(*) FILTER (NOT inside AND wanted) OVER w, count(*) FILTER (inside AND NOT wanted) OVER w), 0) AS swaps
  FROM p WINDOW w AS (PARTITION BY query_id)),
o AS (SELECT query_id, nth_out AS k, pos AS place FROM n WHERE inside AND NOT wanted AND nth_out <= swaps)
SELECT query_id, record_id, pos AS place FROM n WHERE inside AND NOT (NOT wanted AND nth_out <= swaps)
UNION ALL SELECT n.query_id, n.record_id, o.place FROM n JOIN o ON o.query_id = n.query_id AND o.k = n.nth_in WHERE NOT inside AND wanted AND nth_in <= swaps""")
def pdf_quota_swap(spark, sf_dir):
    """A third of six anchors for one kind of source (here: German texts)."""
    return fuse.with_quota(_pool(spark, sf_dir), 6, F.col("lang") == "de")


ANCHORS = f"""anchors AS (SELECT query_id, record_id AS doc_id, rank AS pos, record_id % 5 AS ordinal FROM sparse WHERE rank <= 6),
chunk AS (SELECT doc_id, ordinal FROM lines)"""


@query(f"""WITH {OVERLAP}, {LINES}, {ANCHORS},
near AS (SELECT a.query_id, a.pos, c.doc_id, c.ordinal, CAST(abs(c.ordinal - a.ordinal) AS BIGINT) AS distance FROM anchors a JOIN chunk c ON c.doc_id = a.doc_id AND abs(c.ordinal - a.ordinal) BETWEEN 1 AND 2
  WHERE NOT EXISTS (SELECT 1 FROM anchors x WHERE x.query_id = a.query_id AND x.doc_id = c.doc_id AND x.ordinal = c.ordinal))
SELECT query_id, doc_id, ordinal, pos AS anchor_pos, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, ordinal ORDER BY pos, distance) AS nth FROM near) WHERE nth = 1""")
def neighbour_expand(spark, sf_dir):
    hits = search.overlap_topk(_docs(spark, sf_dir), _asked(spark, sf_dir)).where("rank <= 6")
    anchors = hits.select("query_id", F.col("record_id").alias("doc_id"), F.col("rank").alias("pos"), (F.col("record_id") % 5).alias("ordinal"))
    chunks = ingest.line_chunks(table(spark, sf_dir, "documents")).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"))
    return fuse.neighbours(anchors, chunks, 2)


@query("""WITH topics AS (SELECT page_id, url, regexp_extract(url, '//([^/]+)/', 1) AS site, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title FROM pages),
a AS (SELECT doc_id, 'h' || (doc_id % 7) AS k, lang FROM documents),
j AS (SELECT a.doc_id, t.page_id, length(t.title) AS score FROM a JOIN topics t ON regexp_extract(t.url, '/([a-z]{2})/', 1) = a.lang AND t.page_id % 50 = a.doc_id % 50)
SELECT doc_id, page_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_id) AS nth FROM j) WHERE nth = 1""")
def reference_join(spark, sf_dir):
    """The best page of each document's language and slot: an anchor's reference, first of equal scores.

    All documents of a language and slot have the same best page, so it is found once for each of these.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"), (F.col("page_id") % 50).alias("slot"), F.length(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("score"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 50).alias("slot"))
    place = F.struct(F.col("score").isNull().alias("unscored"), (-F.col("score")).alias("order"), "page_id")
    best = stored(pages.groupBy("lang", "slot").agg(F.min(place).alias("best")), "best-pages")
    found = docs.join(F.broadcast(best) if best.limit(BEST_PAGES + 1).count() <= BEST_PAGES else best, ["lang", "slot"])
    return found.groupBy("doc_id").agg(F.min("best").alias("best")).select("doc_id", "best.page_id")


@query(f"WITH RECURSIVE {OVERLAP}, ev AS (SELECT query_id, rank AS pos, record_id, CAST((length(d.text) + 3) // 4 AS BIGINT) AS tokens FROM sparse JOIN documents d ON d.doc_id = record_id), " + STEP_BUDGET.format(budget=1500))
def context_budget(spark, sf_dir):
    hits = search.overlap_topk(_docs(spark, sf_dir), _asked(spark, sf_dir)).join(_docs(spark, sf_dir), "record_id")
    return fuse.budgeted(hits.select("query_id", F.col("rank").alias("pos"), "record_id", T.token_estimate(F.col("text")).alias("tokens")), 1500)


@query(f"WITH RECURSIVE {OVERLAP}, {DENSE}, {RRF}, {DIVERSE}, ev AS (SELECT query_id, pos, record_id, CAST((length(d.text) + 3) // 4 AS BIGINT) AS tokens FROM pool JOIN documents d ON d.doc_id = record_id WHERE pos <= 6), " + STEP_BUDGET.format(budget=4000))
def hybrid_retrieve(spark, sf_dir):
    """The flagship: dense and sparse routes, fusion, diversity, budget, for all queries in one plan."""
    pool = _pool(spark, sf_dir).where("pos <= 6")
    return fuse.budgeted(pool.select("query_id", "pos", "record_id", T.token_estimate(F.col("text")).alias("tokens")), 4000)


@query(f"""WITH {OVERLAP.replace("FROM documents)", "FROM documents WHERE lang = 'en' AND source < 'src5')")} SELECT query_id, record_id, score, rank FROM sparse""")
def retrieve_with_filters(spark, sf_dir):
    return search.overlap_topk(_docs(spark, sf_dir).where("lang = 'en' AND source < 'src5'"), _asked(spark, sf_dir))


@query(f"""WITH {OVERLAP}, rel AS (SELECT b.item_id AS query_id, l.doc_id FROM benchmark b JOIN labels l ON l.doc_id % 40 = b.item_id % 40 AND l.quality = 1),
r AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
h AS (SELECT s.query_id, count(*) AS hits, min(s.rank) AS first FROM sparse s JOIN rel ON rel.query_id = s.query_id AND rel.doc_id = s.record_id AND s.rank <= 6 GROUP BY 1)
SELECT count(*) AS cases, round(avg(coalesce(CAST(hits AS DOUBLE) / n, 0)), 9) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 9) AS mrr_at_k FROM r LEFT JOIN h USING (query_id)""")
def eval_recall_mrr(spark, sf_dir):
    relevant = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", (F.col("doc_id") % 40).alias("slot"))
    cases = _asked(spark, sf_dir).select("query_id", (F.col("query_id") % 40).alias("slot")).join(relevant, "slot").select("query_id", F.col("doc_id").alias("record_id"))
    hits = search.overlap_topk(_docs(spark, sf_dir), _asked(spark, sf_dir)).where("rank <= 6")
    found = hits.join(cases, ["query_id", "record_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"))
    each = cases.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(found, "query_id", "left")
    return each.agg(
        F.count(F.lit(1)).alias("cases"),
        F.round(F.avg(F.coalesce(F.col("hits") / F.col("n"), F.lit(0.0))), 9).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 9).alias("mrr_at_k"),
    )


# --- lifecycle ----------------------------------------------------------------------------------------------

BUILDS = "builds AS (SELECT l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS version, l_linestatus = 'F' AS finished, l_partkey AS chunk_id FROM lineitem)"


def _builds(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").cast("long").alias("version"), (F.col("l_linestatus") == "F").alias("finished"), F.col("l_partkey").alias("chunk_id"))


@query(f"WITH {BUILDS} SELECT document_id, max(version) AS active_version FROM builds WHERE finished GROUP BY 1")
def version_snapshot(spark, sf_dir):
    return lifecycle.active_versions(_builds(spark, sf_dir))


@query(f"WITH {BUILDS}, a AS (SELECT document_id, max(version) AS version FROM builds WHERE finished GROUP BY 1) SELECT document_id, version, chunk_id FROM builds b WHERE EXISTS (SELECT 1 FROM a WHERE a.document_id = b.document_id AND a.version = b.version)")
def visibility_semi_join(spark, sf_dir):
    b = _builds(spark, sf_dir)
    return lifecycle.visible(b, lifecycle.active_versions(b)).select("document_id", "version", "chunk_id")


@query("""WITH d AS (SELECT event_id, user_id, ts, CAST(floor(value * 10) AS BIGINT) AS sequence FROM events),
s AS (SELECT *, max(sequence) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM d)
SELECT user_id AS task_id, event_id AS delivery_id, sequence FROM s WHERE seen IS NULL OR sequence > seen""")
def claim_fence(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("delivery_id"), F.col("ts").alias("arrived_at"), F.floor(F.col("value") * 10).cast("long").alias("sequence"))
    return lifecycle.accepted_deliveries(d).select("task_id", "delivery_id", "sequence")


@query("SELECT source, sha256, doc_id FROM (SELECT source, sha256(text) AS sha256, doc_id, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1")
def fingerprint_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha256"), "doc_id")
    return lifecycle.first_by_key(rows, ["source", "sha256"], "doc_id")


@query("""WITH s AS (SELECT user_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM events)
SELECT from_state, state AS to_state, count(*) AS times FROM s WHERE from_state <> state AND (from_state, state) NOT IN (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'error'), ('click', 'error')) GROUP BY 1, 2""")
def state_transition_audit(spark, sf_dir):
    allowed = spark.createDataFrame([("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "error"), ("click", "error")], "from_state string, to_state string")
    states = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("seq"))
    return lifecycle.illegal_transitions(states, allowed)


@query("""SELECT o_orderkey AS key, o_orderdate AS modified_at FROM orders o WHERE o_orderdate <= TIMESTAMP '1996-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""")
def staging_sweep(spark, sf_dir):
    objects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("modified_at"))
    references = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return lifecycle.unreferenced(objects, references, F.lit("1996-01-01").cast("timestamp_ntz"))


@query("""SELECT c_custkey AS corpus_id, count(o_orderkey) AS n_jobs, CASE WHEN count_if(o_orderstatus = 'F') > 0 THEN 'READY' WHEN count_if(o_orderstatus = 'O') > 0 THEN 'PROCESSING' WHEN count(o_orderkey) > 0 THEN 'FAILED' ELSE 'EMPTY' END AS status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def corpus_status(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    j = table(spark, sf_dir, "customer").select("c_custkey").join(jobs, F.col("c_custkey") == F.col("o_custkey"), "left")
    status = F.when(F.col("f") > 0, "READY").when(F.col("o") > 0, "PROCESSING").when(F.col("n") > 0, "FAILED").otherwise("EMPTY")
    return j.select(F.col("c_custkey").alias("corpus_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_jobs"), status.alias("status"))


@query("SELECT r_name, n_name, o_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE l_returnflag = 'R' AND o_orderstatus = 'F' ORDER BY o_orderdate, o_orderkey, l_linenumber LIMIT 100")
def outbox_fifo(spark, sf_dir):
    """The oldest hundred of a queue, through its chain of owners."""
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.orderBy("o_orderdate", "o_orderkey", "l_linenumber").limit(100).select("r_name", "n_name", "o_orderkey", "l_linenumber")


@query("SELECT c_custkey, coalesce((SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey), TIMESTAMP '1970-01-01') AS last_activity FROM customer")
def last_activity(spark, sf_dir):
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest"))
    j = table(spark, sf_dir, "customer").join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("latest", F.lit("1970-01-01").cast("timestamp_ntz")).alias("last_activity"))


@query("""WITH c AS (SELECT s_suppkey AS key, s_name AS name FROM supplier), u AS (SELECT l_suppkey AS key, 'order ' || max_by(l_orderkey, (l_orderkey, l_linenumber)) AS name FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT key, name FROM c WHERE key NOT IN (SELECT key FROM u) UNION ALL SELECT key, name FROM u""")
def idempotent_upsert(spark, sf_dir):
    current = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    changes = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("key"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("name"), F.struct("l_orderkey", "l_linenumber").alias("seq"))
    return lifecycle.upserted(current, changes, "key")


# --- telemetry ----------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, round(count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) / 300.0::DOUBLE, 9) AS rate FROM events")
def rate_5m(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    return lifecycle.trailing_rate(e, 300, "event_type").select("event_id", "event_type", "rate")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 9) AS rate FROM events GROUP BY 1, 2")
def rate_by_label(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.withColumn("rate", F.round(F.col("n") / 3600.0, 9))


@query("SELECT date_trunc('day', ts) AS day, round(count(*) FILTER (event_type = 'error') / greatest(CAST(count(*) AS DOUBLE), 1e-9), 9) AS error_ratio FROM events GROUP BY 1")
def error_ratio(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    return e.agg(F.round(F.count_if(F.col("event_type") == "error") / F.greatest(F.count(F.lit(1)).cast("double"), F.lit(1e-9)), 9).alias("error_ratio"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(median(value), 6) AS median FROM events GROUP BY 1")
def latency_p95(spark, sf_dir):
    return lifecycle.percentiles(table(spark, sf_dir, "events"), "event_type", {"p50": 0.5, "p95": 0.95, "median": 0.5})


#: Attempts to log in from events: seven addresses with three accounts each, ten minutes of the table as one second.
_ATTEMPTS = """a AS (SELECT event_id AS attempt_id, CAST(user_id % 7 AS VARCHAR) AS ip, user_id % 7 || '|' || lower(trim(' User' || user_id % 21 || ' ')) AS account, epoch_us(ts) // 600 AS us, event_type = 'signup' AND event_id % 5 = 0 AS success FROM events)"""


def _waits_sql(key: str, limit: int) -> str:
    """Failures before each attempt, 300 s old at most and after the last success of its key, pair by pair."""
    return f"""{key}_last AS (SELECT *, max(CASE WHEN success THEN nth END) OVER (PARTITION BY {key} ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reset
  FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us, attempt_id) AS nth FROM a)),
{key}_seen AS (SELECT l.attempt_id, count(b.us) AS recent, CASE WHEN count(b.us) >= {limit} THEN greatest((min(b.us) + 900000000 - max(l.us)) / 1e6::DOUBLE, 0) ELSE 0 END AS wait
  FROM {key}_last l LEFT JOIN {key}_last b ON b.{key} = l.{key} AND NOT b.success AND b.nth < l.nth AND b.nth > coalesce(l.reset, 0) AND b.us >= l.us - 300000000 GROUP BY 1)"""


@query(f"""WITH {_ATTEMPTS}, {_waits_sql("account", 10)}, {_waits_sql("ip", 30)}
SELECT attempt_id, c.recent AS by_account, i.recent AS by_address, round(greatest(c.wait, i.wait), 6) AS wait FROM account_seen c JOIN ip_seen i USING (attempt_id)""")
def login_limiter(spark, sf_dir):
    """For how long each attempt to log in is refused: ten failures of an address and account within five minutes, or
    thirty of an address, block for fifteen minutes from the oldest one; a success clears both."""
    user = F.col("user_id")
    ip = (user % 7).cast("string")
    account = F.concat_ws("|", ip, F.lower(F.trim(F.concat(F.lit(" User"), (user % 21).cast("string"), F.lit(" ")))))
    success = (F.col("event_type") == "signup") & (F.col("event_id") % 5 == 0)
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("attempt_id"), ip.alias("ip"), account.alias("account"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600).alias("at"), success.alias("success"))
    own = lifecycle.login_waits(a, "account", 10).select("attempt_id", F.col("recent").alias("by_account"), F.col("wait").alias("_own"))
    address = lifecycle.login_waits(a, "ip", 30).select("attempt_id", F.col("recent").alias("by_address"), F.col("wait").alias("_address"))
    return own.join(address, "attempt_id").select("attempt_id", "by_account", "by_address", F.greatest("_own", "_address").alias("wait"))


@query("""WITH s AS (SELECT event_type, CAST(ceil(epoch_us(ts) / 60000000.0::DOUBLE) AS BIGINT) * 60 AS first FROM events),
t AS (SELECT event_type, first + 60 * unnest(range(5)) AS sampled FROM s)
SELECT t.event_type, t.sampled, round((SELECT count(*) FROM events e WHERE e.event_type = t.event_type AND epoch_us(e.ts) > (t.sampled - 300) * 1000000 AND epoch_us(e.ts) <= t.sampled * 1000000) / 300.0::DOUBLE, 9) AS rate
FROM (SELECT DISTINCT event_type, sampled FROM t) t""")
def rate_sampled(spark, sf_dir):
    """The five-minute rate of each type of event, sampled every minute."""
    return lifecycle.sampled_rate(table(spark, sf_dir, "events"), 300, 60, "event_type")


@query("""WITH p AS (SELECT event_type, epoch_us(ts) // 3600000000 AS slot, avg(value) AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2)
SELECT event_type, slot, round(v, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY slot DESC) AS nth FROM p) WHERE nth <= 100""")
def range_scan(spark, sf_dir):
    """At most a hundred points of each series, the newest ones."""
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    p = table(spark, sf_dir, "events").where("value IS NOT NULL AND NOT isnan(value)").groupBy("event_type", slot.alias("slot")).agg(F.avg("value").alias("v"))
    nth = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("slot")))
    return p.withColumn("nth", nth).where("nth <= 100").select("event_type", "slot", F.round("v", 6).alias("value"))


# --- conversations ------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, CAST(greatest((length(text) + length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) + 3) // 4, 1) AS BIGINT) AS tokens FROM conversations")
def message_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", T.message_estimate(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back > 1 AND back <= 4")
def history_window(spark, sf_dir):
    return lifecycle.recent_history(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 3)


@query(r"""WITH m AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 4 = 3 THEN 'tool' ELSE role END AS role, role = 'assistant' AND turn % 4 = 1 AS calls_tools,
  greatest((length(text) + length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) + 3) // 4, 1) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations),
l AS (SELECT *, max(CASE WHEN role = 'user' AND nth > 1 THEN nth END) OVER (PARTITION BY conv_id) AS latest, count(*) OVER (PARTITION BY conv_id) AS n, sum(tokens) OVER (PARTITION BY conv_id) AS everything FROM m),
g AS (SELECT *, (SELECT max(h.nth) FROM m h WHERE h.conv_id = l.conv_id AND h.nth <= l.nth AND NOT (h.role = 'tool' AND h.nth > 2 AND coalesce((SELECT arg_max(p.calls_tools, p.nth) FROM m p WHERE p.conv_id = h.conv_id AND p.nth < h.nth AND p.role <> 'tool'), FALSE))) AS head FROM l),
u AS (SELECT *, (SELECT sum(o.tokens) FROM g o WHERE o.conv_id = g.conv_id AND (o.nth = 1 OR o.nth >= o.latest)) AS needed, coalesce((SELECT sum(o.tokens) FROM g o WHERE o.conv_id = g.conv_id AND o.head >= g.head AND o.nth > 1 AND coalesce(o.nth < o.latest, TRUE)), 0) AS own FROM g)
SELECT conv_id, turn, CAST(needed + own AS BIGINT) AS used FROM u WHERE everything <= 200 OR n <= 2 OR nth = 1 OR nth >= latest OR (latest IS NOT NULL AND needed + own <= 200)""")
def context_trim(spark, sf_dir):
    """Of each conversation what fits into 200 tokens; every second answer stands for a tool call and its result."""
    c = table(spark, sf_dir, "conversations")
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 3), "tool").otherwise(F.col("role"))
    calls = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    m = c.select("conv_id", "turn", role.alias("role"), calls.alias("calls_tools"), T.message_estimate(F.col("text")).alias("tokens"))
    return lifecycle.trimmed_context(m, 200, 0).select("conv_id", "turn", "used")


@query("""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS key FROM conversations),
f AS (SELECT conv_id, key, min(turn) AS first FROM w GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first, key) AS citation FROM f)
SELECT conv_id, key, citation FROM n WHERE citation <= 60""")
def evidence_pool(spark, sf_dir):
    """The first sixty distinct keys of a conversation, numbered by first appearance."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("key"))
    f = w.groupBy("conv_id", "key").agg(F.min("turn").alias("first"))
    n = f.withColumn("citation", F.row_number().over(W.partitionBy("conv_id").orderBy("first", "key")).cast("long"))
    return n.where("citation <= 60").select("conv_id", "key", "citation")


@query("SELECT c.conv_id, c.turn, len(list_filter(list_distinct(regexp_extract_all(lower(c.text), '[a-z][a-z0-9_.-]+')), lambda t: NOT list_contains(regexp_extract_all(lower(p.text), '[a-z][a-z0-9_.-]+'), t))) AS introduced FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def rewrite_guard(spark, sf_dir):
    """How many tokens a turn brings in that the turn before does not have."""
    t = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9_.-]+"), F.lit(0)))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("tokens"))
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("tokens").alias("before"))
    return c.join(p, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_except("tokens", "before")).cast("long").alias("introduced"))


# --- streams ------------------------------------------------------------------------------------------------


@query(ORACLE_SQL["claim_fence"])
def claim_fence_stream(spark, sf_dir):
    """The same claims through a stateful stream over the events' files."""
    e = tasks.table_stream(spark, sf_dir, "events")
    d = e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("delivery_id"), F.col("ts").alias("arrived_at"), F.floor(F.col("value") * 10).cast("long").alias("sequence"))
    return tasks.drained(tasks.claims(d))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts_stream(spark, sf_dir):
    e = tasks.table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = tasks.drained(tasks.windowed_counts(e, "1 hour"), "complete")
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query(r"""WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS seq, (epoch_us(ts) - 1700000000000000) / 1e6::DOUBLE AS came, abs(value) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
b AS (SELECT key, seq, nth, came, cost, 50.0::DOUBLE AS level, came AS start, CASE WHEN cost > 50 THEN 0 ELSE greatest(0, (cost - 50) / 0.001::DOUBLE) END AS wait FROM r WHERE nth = 1
  UNION ALL
  SELECT n.key, n.seq, n.nth, n.came, n.cost, n.level, n.start, CASE WHEN n.cost > 50 THEN 0 ELSE greatest(0, (n.cost - n.level) / 0.001::DOUBLE) END FROM (
    SELECT r.key, r.seq, r.nth, r.came, r.cost, greatest(r.came, b.start + b.wait) AS start,
      least(50.0::DOUBLE, greatest(0, b.level + b.wait * 0.001::DOUBLE - b.cost) + (greatest(r.came, b.start + b.wait) - (b.start + b.wait)) * 0.001::DOUBLE) AS level
    FROM b JOIN r ON r.key = b.key AND r.nth = b.nth + 1) n)
SELECT key, seq, round(round(start + wait - came, 6), 3) AS wait FROM b""")
def token_bucket(spark, sf_dir):
    at = (F.unix_micros(F.col("ts").cast("timestamp")) - 1_700_000_000_000_000) / 1e6  # small numbers keep their digits
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), at.alias("at"), F.abs("value").alias("cost"))
    return tasks.token_bucket(r, 0.001, 50.0).withColumn("wait", F.round("wait", 3))


@query("""WITH RECURSIVE s AS (SELECT user_id AS key, event_id AS seq, (value % 100 + 100) % 100 / 100 AS used, (value * 7 % 100 + 100) % 100 / 100 AS free, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
f AS (SELECT key, 0::BIGINT AS nth, 1 AS step, NULL::BIGINT AS seq, FALSE AS paused FROM s GROUP BY key
  UNION ALL
  SELECT s.key, s.nth, CASE WHEN used >= 0.8 OR free < 0.2 THEN least(step + 1, 6) WHEN used < 0.7 THEN greatest(step - 1, 1) ELSE step END, s.seq, used >= 0.9 OR free < 0.1
  FROM f JOIN s ON s.key = f.key AND s.nth = f.nth + 1)
SELECT key, seq, CAST([168, 96, 48, 24, 6, 1][step] AS BIGINT) AS hours, paused FROM f WHERE nth > 0""")
def retention_ladder(spark, sf_dir):
    share = lambda x: F.pmod(x, F.lit(100.0)) / 100
    s = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), share(F.col("value")).alias("used"), share(F.col("value") * 7).alias("free"))
    return tasks.retention(s)
