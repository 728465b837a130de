"""Tables that are written by key: rows in hash buckets, of which a write makes only those anew that its keys fall into.

A write puts the touched buckets into a folder of its own and then, as one small file, a version that names the folder of every
bucket.  A write that breaks off before that is never seen, readers of an earlier version keep their files, and two writers can't finish the same version.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import delete

BUCKETS = 64


class KeyedTable:
    """One row or several per key, below ``path``; ``buckets`` is fixed by the first write."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _versions(self) -> DataFrame | None:
        """(version, bucket, folder)."""
        try:
            return self.spark.read.parquet(f"{self.path}/versions")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def current(self) -> tuple[int, dict[int, str]]:
        """The last finished version (-1: none), and where its buckets are: a row for each of ``buckets`` at most."""
        rows = self._versions()
        last = None if rows is None else rows.agg(F.max("version")).first()[0]
        if last is None:
            return -1, {}
        return last, {r["bucket"]: r["folder"] for r in rows.where(F.col("version") == last).collect() if r["folder"]}

    def _rows(self, folders: dict[int, str], like: DataFrame | None = None) -> DataFrame | None:
        paths = [f"{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        if not paths:
            return None if like is None else like.limit(0)
        return self.spark.read.parquet(*paths)

    def read(self) -> DataFrame | None:
        """All rows of the last finished version; none before the first write."""
        return self._rows(self.current()[1])

    def _commit(self, version: int, before: dict[int, str], touched: list[int], rows: DataFrame) -> None:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket", self._bucket())
        dealt.repartition(min(len(touched), self.buckets), "bucket").write.partitionBy("bucket").parquet(folder)
        filled = {r["bucket"] for r in self.spark.read.schema(dealt.schema).parquet(folder).select("bucket").distinct().collect()}
        after = {b: f for b, f in before.items() if b not in touched} | dict.fromkeys(filled, folder)
        named = self.spark.createDataFrame([(b, f) for b, f in sorted(after.items())] or [(-1, "")], "bucket int, folder string")
        named.coalesce(1).write.mode("error").parquet(f"{self.path}/versions/version={version}")

    def replace(self, keys: DataFrame, fresh: DataFrame | None = None) -> list[int]:
        """All rows of ``keys`` go, those of ``fresh`` come (their keys go, too); the buckets that were written anew."""
        version, before = self.current()
        gone = keys.select(self.key) if fresh is None else keys.select(self.key).unionByName(fresh.select(self.key))
        gone = gone.distinct()
        touched = sorted(r[0] for r in gone.select(self._bucket()).distinct().collect())  # ``buckets`` numbers at most
        if not touched:
            return []
        old = self._rows({b: f for b, f in before.items() if b in touched}, fresh)
        parts = [p for p in (None if old is None else old.join(gone, self.key, "left_anti"), fresh) if p is not None]
        if parts:
            self._commit(version + 1, before, touched, reduce(lambda a, b: a.unionByName(b), parts))
        return touched

    def upsert(self, fresh: DataFrame) -> list[int]:
        """Rows of keys that come again are replaced, other keys are added."""
        return self.replace(fresh.select(self.key), fresh)

    def vacuum(self) -> int:
        """Removes the folders of all versions but the last, once nobody reads those any more; how many."""
        version, folders = self.current()
        rows = self._versions()
        if rows is None:
            return 0
        old = {r["folder"] for r in rows.select("folder").distinct().collect() if r["folder"]} - set(folders.values())
        for folder in old:
            delete(self.spark, folder)
        for r in rows.select("version").where(F.col("version") < version).distinct().collect():
            delete(self.spark, f"{self.path}/versions/version={r['version']}")
        return len(old)
