"""A table with a key in a folder: changes by key, deletion by filter, readers that keep the version they began with.

Rows lie in buckets by a hash of their key. A version is a manifest, a small file that names the folder of each bucket;
a change writes new folders for the buckets that it touches, and appears as a whole when the next manifest gets its
name by one rename. Until then nothing is visible, so a writer that ends early leaves only folders that nothing names.
A rename onto a name that another writer took fails, and the change is made again on that writer's version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_BUCKET = "_bucket"


class KeyedTable:
    """``schema`` is the table's, ``key`` one of its columns; null keys are keys."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, buckets: int = 64, tries: int = 5):
        self.spark, self.folder, self.schema, self.key, self.buckets, self.tries = spark, folder.rstrip("/"), schema, key, buckets, tries
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions -------------------------------------------------------------------------------------------

    def version(self) -> int:
        """The newest version; 0 before anything is written."""
        folder = self._path(f"{self.folder}/versions")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        rows = self.spark.read.text(f"{self.folder}/versions/{version:012d}", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _publish(self, version: int, manifest: dict[str, str]) -> bool:
        """Whether ``manifest`` became the given version; not if there is one already."""
        draft, final = self._path(f"{self.folder}/drafts/{uuid.uuid4().hex}"), self._path(f"{self.folder}/versions/{version:012d}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, final, options)  # fails if the name is taken
        except Exception:
            if not self._fs.exists(final):
                raise
            self._fs.delete(draft, False)
            return False
        return True

    # --- reading --------------------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version (the newest if none is named); later changes do not show in it."""
        manifest = self._manifest(self.version() if version is None else version)
        return self._rows(manifest.values())

    def _rows(self, folders) -> DataFrame:
        paths = [f"{self.folder}/{x}" for x in sorted(folders)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    # --- changing -------------------------------------------------------------------------------------------

    def upsert(self, changes: DataFrame, order: str | None = None) -> int:
        """Put in the rows of ``changes``, in place of those with their keys; returns the new version.

        Of changes with one key the last by ``order`` counts (by all columns, if none is named). All of them show, or none.
        """
        names = self.schema.fieldNames()
        last = F.row_number().over(W.partitionBy(self.key).orderBy(*([F.desc(order)] if order else []), *[F.desc(c) for c in names]))
        new = changes.withColumn("_nth", last).where("_nth = 1").select(*names)

        def merged(old: DataFrame) -> DataFrame:
            keys = new.select(F.col(self.key).alias("_key"))
            return old.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti").unionByName(new)

        return self._changed(new.select(self._bucket().alias(_BUCKET)), merged)

    def delete(self, condition: Column | str) -> int:
        """Take out the rows for which ``condition`` is true; returns the new version (the old one if there are none)."""
        where = F.expr(condition) if isinstance(condition, str) else condition
        return self._changed(lambda old: old.where(where).select(self._bucket().alias(_BUCKET)), lambda old: old.where(~F.coalesce(where, F.lit(False))))

    def _changed(self, touched: DataFrame | Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame]) -> int:
        for _ in range(self.tries):
            version = self.version()
            manifest = self._manifest(version)
            rows = touched(self._rows(manifest.values())) if callable(touched) else touched
            buckets = sorted(r[0] for r in rows.distinct().collect())  # as many as buckets at most
            if not buckets:
                return version
            old = self._rows(manifest[str(b)] for b in buckets if str(b) in manifest)
            name = f"data/{uuid.uuid4().hex}"
            change(old).withColumn(_BUCKET, self._bucket()).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.folder}/{name}")
            written = {x.getPath().getName().partition("=")[2] for x in self._fs.listStatus(self._path(f"{self.folder}/{name}")) if x.isDirectory()}
            kept = {b: x for b, x in manifest.items() if int(b) not in buckets}
            if self._publish(version + 1, kept | {b: f"{name}/{_BUCKET}={b}" for b in written}):
                return version + 1
        raise RuntimeError(f"another writer was faster {self.tries} times")

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last ``keep`` versions, and folders that none of these names: no writer may be at work."""
        newest = self.version()
        named = {x.split("/")[1] for v in range(max(newest - keep, 0) + 1, newest + 1) for x in self._manifest(v).values()}
        for folder, stays in (("data", named), ("drafts", set()), ("versions", {f"{v:012d}" for v in range(max(newest - keep, 0) + 1, newest + 1)})):
            path = self._path(f"{self.folder}/{folder}")
            for x in self._fs.listStatus(path) if self._fs.exists(path) else []:
                if x.getPath().getName().lstrip(".").removesuffix(".crc") not in stays:
                    self._fs.delete(x.getPath(), True)
