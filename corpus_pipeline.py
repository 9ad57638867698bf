"""A corpus pipeline of five operators: each stage's output is written as Parquet and is the next one's input.

Quality classifier, exact dedup, n-gram Jaccard join, mixing to target weights, BPE encoding. Stages work on all
that the one before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidencespark.llm import block_naming, bpe, mixing, ngram_join, quality
from evidencespark.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.5 or more).

    Null and empty texts have the score of no words; repeated rows and null ids are scored like any row, columns
    stay whatever their names, and an empty table stays empty.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.quality_scores(docs, model)
    name = scored.columns[-1]
    return scored.where(F.col(name) >= 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id (a null id loses to any other).

    Null and empty texts are one group; of repeated rows one stays. Columns stay, and an empty table stays empty.
    """
    return block_naming.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of texts that share 75 % of their five-word shingles.

    Decided by row, so rows that share an id or have none are told apart by their texts; null and empty texts link
    with nothing and stay. Columns stay, and an empty table stays empty.
    """
    return ngram_join.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shuffled within output shards.

    Null sources are a source, null and empty texts have no words and come with their block; repeated rows are drawn
    alike. The result has the columns of ``docs``, and an empty table stays empty.
    """
    return mixing.mix_sources(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its token ids in place of its text, and whether decoding them gives back the text.

    Null and empty texts have no ids. A column of ``docs`` named ``ids``, ``n_tokens`` or ``round_trip`` stays; the new
    one then gets underscores before its name. An empty table stays empty.
    """
    lexicon = bpe.build_lexicon(docs, bpe.default_vocabulary())
    return bpe.encode_texts(docs, lexicon, outputs=("ids", "n_tokens", "round_trip"), keep_text=False)


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mix", mix),
    ("bpe", encode),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``; intermediate tables go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
