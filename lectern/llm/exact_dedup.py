"""Exact dedup with a log-structured merge index, in DataFrame operations alone.

A memtable is what one task reads: its (digest, identifier) entries are sorted in the
task and flushed as one sorted run file, without a shuffle.  A flush also writes the
filter of its run: bitmaps of the digests' hashes, and the least and greatest digest.  A lookup
asks the filters first and reads the runs that may hold a digest alone.  When a level
holds FAN_IN runs they are merged into one of the next level: an entry per
digest with the least and greatest identifier and the number of rows.

Dedup flushes all rows and compacts.  Digests of several rows go into a filter of bounded size, so
only rows that may hit it are joined with the index: texts without a copy are not
shuffled.  Hits are compared with the text of the row that stays, byte by byte.

Digests of more than one in a thousand rows are hot: at most a thousand of them
exist, so their list is broadcast; their rows are dealt out by a salt, and the
texts to compare with are repeated once per salt.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmaps_for, delete, make_filter, materialize, may_hold, run_dir, text_or_empty, write

#: One in so many rows makes a digest hot; also the most hot digests there can be.
HOT_SHARE = 1000
SALTS = 64
#: Runs of a level that are merged into one of the next.
FAN_IN = 4
ENTRY = "digest binary, least long, most long, n long, n_ids long"


def entries(runs: DataFrame) -> DataFrame:
    """Merges the entries of runs: one per digest.  Partial aggregates come before the shuffle, so a hot digest sends one entry a task."""
    return runs.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"), F.sum("n_ids").alias("n_ids"))


class LsmIndex:
    """Sorted runs of (digest; least, most: identifiers; n: rows; n_ids: rows with an identifier) in levels, in one shared folder.

    The manifest is a table of (version, level, run, size, bitmaps, low, high) that is written
    last: a flush or merge that was cut off leaves files that no version names.  One writer at a time; readers open the index anew after a merge.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.path = (path or f"{run_dir(spark)}/lsm-{uuid.uuid4().hex}").rstrip("/")
        self.version, self.runs = 0, []
        self.read_runs: list[str] = []

    def _read(self, run: str, part: str = "entries") -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{run}/{part}")

    def flush(self, rows: DataFrame) -> str:
        """Writes (id, digest) rows as sorted run files, one per task, with their filter; returns the run's name."""
        known = F.col("id").isNotNull().cast("long")
        table = rows.select("digest", F.col("id").alias("least"), F.col("id").alias("most"), F.lit(1).cast("long").alias("n"), known.alias("n_ids"))
        return self._write(table.sortWithinPartitions("digest"), 0)

    def _write(self, table: DataFrame, level: int) -> str:
        run = f"run-{uuid.uuid4().hex}"
        write(table, f"{self.path}/{run}/entries", **{"parquet.bloom.filter.enabled#digest": "true"})
        whole = self._read(run)
        facts = whole.agg(F.count(F.lit(1)), F.hex(F.min("digest")), F.hex(F.max("digest"))).first()
        bitmaps = bitmaps_for(facts[0])
        write(make_filter(whole, bitmaps), f"{self.path}/{run}/filter")
        self.runs = [*self.runs, (level, run, facts[0], bitmaps, facts[1] or "", facts[2] or "")]
        return run

    def _commit(self) -> None:
        self.version += 1
        values = ", ".join(f"({self.version}L, {level}, '{run}', {size}L, {bitmaps}, '{low}', '{high}')" for level, run, size, bitmaps, low, high in self.runs)
        table = self.spark.sql(f"SELECT * FROM VALUES {values} AS t(version, level, run, size, bitmaps, low, high)")
        table.coalesce(1).write.parquet(f"{self.path}/manifest-{self.version:09d}")

    @classmethod
    def open(cls, spark: SparkSession, path: str, fan_in: int = FAN_IN) -> LsmIndex:
        """The index as of its last complete version."""
        index = cls(spark, path, fan_in)
        rows = spark.read.parquet(f"{index.path}/manifest-*")
        rows = rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version").collect()  # a row per live run
        index.version = rows[0].version
        index.runs = sorted((r.level, r.run, r.size, r.bitmaps, r.low, r.high) for r in rows)
        return index

    def append(self, rows: DataFrame) -> None:
        """Flushes a batch of (id, digest) and merges levels that are full; merged runs and the manifests that name them go once the new version stands."""
        self.flush(rows)
        level, dead = 0, []
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fan_in:
            merged = entries(self._union([r[1] for r in full])).sortWithinPartitions("digest")
            self._write(merged, level + 1)
            self.runs = [r for r in self.runs if r not in full]
            dead += [r[1] for r in full]
            level += 1
        self._commit()
        if self.version > 1:
            delete(self.spark, f"{self.path}/manifest-{self.version - 1:09d}")
        for run in dead:
            delete(self.spark, f"{self.path}/{run}")

    def _union(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/{run}/entries" for run in runs])

    def compacted(self) -> DataFrame:
        """One entry per digest of all runs."""
        return entries(self._union([r[1] for r in self.runs]))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """The entries of the digests asked for.  Runs whose range or filter excludes all of them are not read (``read_runs`` names the others)."""
        asked = materialize(digests.select("digest").distinct(), "lsm-asked")
        span = asked.agg(F.hex(F.min("digest")), F.hex(F.max("digest"))).first()
        found, self.read_runs = None, []
        for _, run, _, bitmaps, low, high in self.runs:
            if span[0] is None or not low or span[1] < low or span[0] > high:
                continue
            may = may_hold(asked, self._read(run, "filter"), bitmaps).where("may_hold").drop("may_hold")
            if may.isEmpty():
                continue
            self.read_runs.append(run)
            hits = self._read(run).join(may, "digest", "left_semi")
            found = hits if found is None else found.unionByName(hits)
        return entries(self.spark.createDataFrame([], ENTRY) if found is None else found)


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    normalize: Column | None = None,
    payload: list[str] | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest (and ``payload`` columns).

    Texts are equal when their UTF-8 bytes are identical (after ``normalize``, an
    expression over the input, if given).  Null text is the empty text; empty
    texts are equal to each other; a very long text is one value as others are.  ``keep`` is
    "smallest" or "largest": the id that stays.  Null ids never win against others; a group of null ids alone has
    a null keep_id, and its rows count as that one id.  Rows that repeat id and
    text are all reported; one of them is kept.  Other columns are ignored unless
    named in ``payload`` (the text column itself may be); an empty table gives an
    empty result.
    """
    spark, payload = docs.sparkSession, payload or []
    text = text_or_empty(text_column) if normalize is None else F.coalesce(normalize, F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    rows = docs.select(F.col(id_column).alias("id"), text.alias("body"), digest.alias("digest"), F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(payload)]).alias("payload"))

    index = LsmIndex(spark)
    index.flush(rows.select("id", "digest"))
    total = index.runs[0][2]
    which = {"smallest": "least", "largest": "most"}[keep]
    groups = index.compacted().where("n > 1").select("digest", F.col(which).alias("keep_id"), F.col("n").alias("group_size"))
    groups = materialize(groups, "lsm-groups")
    bitmaps = bitmaps_for(groups.count())
    told = may_hold(rows, materialize(make_filter(groups, bitmaps), "lsm-filter"), bitmaps)

    hot = groups.where(F.col("group_size") * HOT_SHARE > total).select("digest", F.lit(SALTS).alias("salts"))
    hot = F.broadcast(hot)  # at most HOT_SHARE rows of 32 bytes: their shares add up to the table

    def salted(df: DataFrame) -> DataFrame:
        return df.join(hot, "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")

    salt = F.coalesce(F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("salts")), F.lit(0)).cast("int")
    passed = told.where("may_hold").drop("may_hold").join(hot, "digest", "left").withColumn("salt", salt).drop("salts")
    # Rows that the filter passes wrongly find no entry here; each row gets a number, to tell repeats apart.
    hits = passed.join(salted(groups), ["digest", "salt"], "left").withColumn("row", F.monotonically_increasing_id())
    hits = materialize(hits, "lsm-hits")
    stays = hits.where("group_size IS NOT NULL AND id <=> keep_id").groupBy("digest").agg(F.min(F.struct("row", "body")).alias("stays"))
    verified = hits.join(salted(stays), ["digest", "salt"], "left")
    same = F.coalesce(F.col("body") == F.col("stays.body"), F.lit(False))
    verified = verified.select(
        "id",
        F.when(same, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.when(same, F.col("group_size")).otherwise(F.lit(1)).cast("long").alias("group_size"),
        (~same | (F.col("row") == F.col("stays.row"))).alias("kept"),
        "digest",
        "payload",
    )
    alone = told.where("NOT may_hold").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "payload")
    return verified.unionByName(alone).select("id", "keep_id", "group_size", "kept", "digest", *[F.col(f"payload.c{k}").alias(c) for k, c in enumerate(payload)])
