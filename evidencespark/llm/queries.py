"""The queries of this subpackage for ``__spark_entry__.py``; what SQL can express has its SQL beside it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencespark.llm import block_naming, bpe, embedding_dedup, html_extract, id_files, merkle, mixing, ngram_join, quality, suffix_dedup, token_rollup, toxicity, whitening
from evidencespark.llm.common import held_out, shared_folder, stored, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null, empty and broken pages give what :func:`.html_extract.extract_main_text` states, and repeated rows come back each."""
    pages = html_extract.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every whole text and what they decode to, as digests; null texts are empty ones, and every row comes back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_texts(docs, bpe.build_lexicon(docs, bpe.default_vocabulary()), outputs=("ids", "decoded", "n_tokens"), keep_text=False)
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every row; nulls, ties and repeats as :func:`.block_naming.exact_groups` states."""
    groups = block_naming.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document; nulls, ties and repeats as :func:`.mixing.mix_summary` states."""
    return mixing.mix_summary(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def _rounds(name: str) -> str:
    """The rounds in which the rows of ``name``1 are filled in, as common table expressions; the last is ``name``_filled."""
    steps, before = [], f"(SELECT *, FALSE AS whole FROM {name}1)"
    for k in range(mixing.ROUNDS):
        steps.append(
            f"{name}_u{k} AS (SELECT *, NOT whole AND size <= rest AND "
            f"sum(CASE WHEN NOT whole AND size <= rest THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank) <= rest AS fits FROM {before}),\n"
            f"{name}_r{k} AS (SELECT * EXCLUDE (whole, fits, rest), whole OR fits AS whole, "
            f"rest - sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest FROM {name}_u{k})"
        )
        before = f"{name}_r{k}"
    return ",\n".join([*steps, f"{name}_filled AS (SELECT *, count(*) FILTER (NOT whole) OVER (PARTITION BY source ORDER BY rank) AS nth FROM {before})"])


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7))::BIGINT % 1024 AS block,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 8, 7))::BIGINT % 1024 AS cell
  FROM documents),
s0 AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size, CAST(sum(size) AS DOUBLE) * 2 AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM d GROUP BY source),
s1 AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
    coalesce(sum(most) OVER f, 0.0::DOUBLE) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER f, 0.0::DOUBLE) AS unfilled
  FROM s0 WINDOW f AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT source, source_size, least(most, max((total - filled) / unfilled) OVER () * weight) AS target FROM s1),
s3 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 2 END AS passes FROM s2),
s AS (SELECT *, CASE WHEN passes < 2 THEN target - passes * source_size ELSE -1.0 END AS rest FROM s3),
b0 AS (SELECT source, block, sum(size) AS size FROM d GROUP BY source, block),
b1 AS (
  SELECT b0.source, b0.block, b0.size, s.rest, row_number() OVER (PARTITION BY b0.source ORDER BY md5('block:0:' || CAST(b0.block AS VARCHAR)), b0.block) AS rank
  FROM b0 JOIN s ON b0.source IS NOT DISTINCT FROM s.source),
{blocks},
b AS (SELECT source, block, rank, whole, NOT whole AND nth <= 32 AND rest > 0 AS part, rest FROM b_filled),
c0 AS (
  SELECT d.source, d.block, d.cell, sum(d.size) AS size, max(b.rank) AS above, max(b.rest) AS rest
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.block = b.block AND b.part GROUP BY d.source, d.block, d.cell),
c1 AS (SELECT source, block, cell, size, rest, row_number() OVER (PARTITION BY source ORDER BY above, md5('cell:0:' || CAST(cell AS VARCHAR)), cell) AS rank FROM c0),
{cells},
c AS (SELECT source, block, cell, whole, NOT whole AND nth <= 32 AND rest > 0 AS part, rest FROM c_filled),
e0 AS (
  SELECT d.source, d.doc_id, row_number() OVER (PARTITION BY d.source ORDER BY abs(c.rest - d.size), md5('doc:0:' || CAST(d.doc_id AS VARCHAR)), d.doc_id) AS nth
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.block = c.block AND d.cell = c.cell AND c.part
  WHERE d.size > 0 AND d.size < 2 * c.rest),
e AS (SELECT source, doc_id FROM e0 WHERE nth = 1)
SELECT d.doc_id, d.size, CAST(s.source_size AS BIGINT) AS source_size, s.target,
  CAST((s.passes + CASE WHEN b.whole OR b.part AND (coalesce(c.whole, FALSE) OR coalesce(c.part, FALSE) AND e.doc_id IS NOT NULL) THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.block = b.block
LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.block = c.block AND d.cell = c.cell
LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.doc_id = e.doc_id
""".replace("{blocks}", _rounds("b")).replace("{cells}", _rounds("c"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the digests: whether anything is removed, and the length of what stays, in bytes and characters."""
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("has_repeats"),
        F.length("kept").cast("long").alias("n_kept"),
        F.col("kept_chars").alias("n_kept_chars"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every vector among those of its label; vectors that are null, zero or not finite stand alone."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, those whose id is divisible by 3 deleted and inserted again (that batch twice), and
    those divisible by 7 revised and revised back; batches are folded into one on the way. What is left are the totals
    of the table."""
    docs = table(spark, sf_dir, "documents")
    counts = stored(token_rollup.token_counts(docs, bpe.build_lexicon(docs, bpe.default_vocabulary()), "byte_bpe_50k"), "token-counts")
    rollup = token_rollup.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    third, seventh = counts.where("doc_id % 3 = 0"), counts.where("doc_id % 7 = 0")
    changed = seventh.withColumn("tokens", F.col("tokens") * 2 + 1)
    rollup.commit("insert", token_rollup.signed(counts))
    rollup.commit("delete", token_rollup.signed(third, -1))
    rollup.commit("revise", token_rollup.revised(seventh, changed))
    rollup.compact("first-three")
    for batch, deltas in (("insert-again", token_rollup.signed(third)), ("insert-again", token_rollup.signed(third)), ("revise-back", token_rollup.revised(changed, seventh))):
        rollup.commit(batch, deltas)
    return rollup.totals()


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document by shared five-word shingles; null and empty texts stand alone."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text by a model of the labels outside the held-out fold; null texts are scored as empty ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity_scores(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text by a model of the labels outside the held-out fold; null texts are scored as empty ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.quality_scores(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; those whose id has an even CRC are folded again without their line ends."""
    text = F.col("text").cast("string")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)
    rows = merkle.manifest(table(spark, sf_dir, "documents"), tampered)
    hexed = lambda c: F.lower(F.hex(c))
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), merkle.folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded"))
    return rows.select("doc_id", *[hexed(c).alias(c) for c in ("leaf", "subroot", "root")], "proof_sha256", hexed("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('+' || source, '') AS k, source, lang, n_chars, text,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], range(8)), lambda x, i: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS crc
  FROM documents),
e AS (
  SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS altered,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
    coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM d),
leaves AS (
  SELECT doc_id, k, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(altered) || ':' || altered, '-')) AS changed
  FROM e),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM leaves),
t1 AS (
  SELECT k, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL SELECT k, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM t1 WHERE n > 1 GROUP BY k, level, pos // 3, n),
sub AS (SELECT k, digest AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM t1 WHERE n = 1),
t2 AS (
  SELECT 0 AS level, pos, n, subroot AS digest FROM sub
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM t2 WHERE n > 1 GROUP BY level, pos // 3, n),
depth AS (SELECT k, max(level) AS deep FROM t1 GROUP BY k),
sides1 AS (
  SELECT a.k, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM t1 a JOIN t1 b ON a.k = b.k AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
sides2 AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM t2 a JOIN t2 b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
way AS (
  SELECT p.k, p.pos AS leaf_pos, s.level AS step, s.l, s.r FROM placed p JOIN sides1 s ON s.k = p.k AND s.pos = p.pos // CAST(3 ** s.level AS BIGINT)
  UNION ALL SELECT p.k, p.pos, depth.deep + s.level, s.l, s.r FROM placed p JOIN depth ON depth.k = p.k JOIN sub ON sub.k = p.k JOIN sides2 s ON s.pos = sub.pos // CAST(3 ** s.level AS BIGINT)),
proofs AS (SELECT k, leaf_pos, string_agg(l || r, '' ORDER BY step) AS proof FROM way GROUP BY ALL),
fold AS (
  SELECT k, pos, 0 AS step, changed AS digest FROM placed
  UNION ALL SELECT fold.k, fold.pos, fold.step + 1, sha256(w.l || fold.digest || w.r) FROM fold JOIN way w ON w.k = fold.k AND w.leaf_pos = fold.pos AND w.step = fold.step),
ends AS (SELECT k, pos, max_by(digest, step) AS folded_root FROM fold GROUP BY ALL),
top AS (SELECT digest AS root FROM t2 WHERE n = 1)
SELECT p.doc_id, p.leaf, sub.subroot, top.root, sha256(coalesce(q.proof, '')) AS proof_sha256, ends.folded_root, ends.folded_root = top.root AS verified
FROM placed p JOIN sub ON sub.k = p.k JOIN ends ON ends.k = p.k AND ends.pos = p.pos LEFT JOIN proofs q ON q.k = p.k AND q.leaf_pos = p.pos CROSS JOIN top
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four whitened components of every vector; null and non-finite ones have no rows, see :func:`.whitening.whiten`."""
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to files in the order of doc_id and read back from them; see :func:`.id_files.write_ids`."""
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    id_files.write_ids(table(spark, sf_dir, "documents"), folder, id_files.default_vocabulary())
    return id_files.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").cast("long").alias("ids_crc32"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_source_mix": op4_source_mix,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_ngram_join": op8_ngram_join,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_whitening": op12_whitening,
    "op13_id_files": op13_id_files,
}

ORACLE_SQL = {"op3_exact_dedup": OP3_SQL, "op4_source_mix": OP4_SQL, "op11_merkle_manifest": OP11_SQL}
