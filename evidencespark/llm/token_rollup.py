"""Token counts as delta-maintained rollups.

Totals are kept by source, language and tokenizer version. A change to the corpus is a batch of signed deltas: an
insert adds a document's tokens, a delete takes them away, a revision does both. Totals are sums, so deltas of any
order and number can be added up, and a batch is committed by adding its folder of deltas under its own name: a
batch that is committed again replaces nothing and counts once. Compaction folds committed batches into one.

A batch's folder is written under a working name and renamed, so a lost driver or executor leaves no half batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evidencespark.llm import bpe

KEYS = ("source", "lang", "version")
SCHEMA = StructType([*(StructField(k, StringType()) for k in KEYS), StructField("docs", LongType()), StructField("tokens", LongType())])


def token_counts(docs: DataFrame, lexicon: bpe.Lexicon, version: str) -> DataFrame:
    """``(doc_id, source, lang, version, tokens)`` of the whole text of each row of ``docs``.

    Null and empty texts have no tokens; repeated rows count each, null ids, sources and languages stay null, other columns
    are ignored, and an empty table gives no rows.
    """
    coded = bpe.encode_texts(docs.select("doc_id", "source", "lang", "text"), lexicon, outputs=("n_tokens",), keep_text=False)
    return coded.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("version"), F.col("n_tokens").alias("tokens"))


def signed(counts: DataFrame, sign: Column | int = 1) -> DataFrame:
    """Deltas of documents that are inserted (``sign`` 1) or deleted (-1)."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    return counts.select(*KEYS, sign.cast("long").alias("docs"), (sign * F.col("tokens")).cast("long").alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that replace the counts of ``old`` by those of ``new``."""
    return signed(old, -1).unionByName(signed(new, 1))


def totals(deltas: DataFrame) -> DataFrame:
    """``(source, lang, version, docs, tokens)``: the sums of deltas; keys that come to nothing are left out.

    Null sources and languages are keys of their own. A hot key is added up in each task before the shuffle.
    """
    summed = deltas.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
    return summed.where("docs <> 0 OR tokens <> 0")


class Rollup:
    """Committed batches of deltas in one folder; the totals are their sums.

    A batch is a folder ``batch=NAME`` with its deltas below ``totals`` and, if it was made by :meth:`compact`, the
    names that it holds below ``folded``. It appears by one rename, and a batch whose name another one has folded
    does not count, so a driver lost at any point leaves totals that are right, at worst with folders to delete.

    Null keys are keys, repeated rows of a batch all count, and an empty batch is committed like any other. One writer
    commits a batch at a time: two that commit the same name together may leave a folder to delete.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _present(self) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def _folded(self, names: list[str]) -> DataFrame:
        """``name``: what the batches ``names`` have folded in."""
        paths = [p for p in (f"{self.folder}/batch={n}/folded" for n in names) if self._fs.exists(self._path(p))]
        return self.spark.read.schema("name string").parquet(*paths) if paths else self.spark.createDataFrame([], "name string")

    def batches(self) -> list[str]:
        """The names of the batches that count: those present which no other one has folded in."""
        names = self._present()
        gone = {r["name"] for r in self._folded(names).where(F.col("name").isin(names)).distinct().collect()} if names else set()
        return [n for n in names if n not in gone]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch under its name; False if that name is committed already (nothing changes then)."""
        if not batch or "/" in batch:
            raise ValueError("a batch needs a name without slashes")
        names = self._present()
        if batch in names or not self._folded(names).where(F.col("name") == batch).isEmpty():
            return False
        totals(deltas).select(*SCHEMA.names).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/_work-{batch}/totals")
        self._publish(batch)
        return True

    def _publish(self, batch: str) -> None:
        if not self._fs.rename(self._path(f"{self.folder}/_work-{batch}"), self._path(f"{self.folder}/batch={batch}")):
            raise OSError(f"batch {batch} could not be renamed; nothing is committed")

    def totals(self) -> DataFrame:
        """The current totals."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return totals(self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/batch={n}/totals" for n in names]))

    def compact(self, into: str) -> None:
        """Fold all batches into a new one named ``into``; their names stay known, so none can be committed again.

        The new batch and the names it holds appear together; the folders of the others are deleted after that, one
        writer at a time. Readers that started before may lose the folders they read.
        """
        names = self._present()
        work = f"{self.folder}/_work-{into}"
        self.totals().select(*SCHEMA.names).coalesce(1).write.mode("overwrite").parquet(f"{work}/totals")
        own = self.spark.createDataFrame([(n,) for n in names], "name string")
        self._folded(names).unionByName(own).distinct().coalesce(1).write.mode("overwrite").parquet(f"{work}/folded")
        self._publish(into)
        for n in names:
            self._fs.delete(self._path(f"{self.folder}/batch={n}"), True)
