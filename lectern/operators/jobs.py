"""The job table: priorities and the algebra of its transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed


def with_priority(jobs: DataFrame) -> DataFrame:
    cells = [x for kind, n in fixed.STAGE_PRIORITY.items() for x in (F.lit(kind), F.lit(n))]
    return jobs.withColumn("priority", F.coalesce(F.try_element_at(F.create_map(*cells), F.col("kind")), F.lit(100)))


def enqueue(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (kind, paper_id) that aren't outstanding yet; null papers collapse too."""
    active = jobs.where(F.col("state").isin("queued", "running")).select("kind", "paper_id").distinct()
    w, a = wanted.select("kind", "paper_id").distinct().alias("w"), active.alias("a")
    return w.join(a, (F.col("w.kind") == F.col("a.kind")) & F.col("w.paper_id").eqNullSafe(F.col("a.paper_id")), "left_anti")


def claimed(jobs: DataFrame, job: DataFrame) -> DataFrame:
    """The table after the given jobs (ids) were claimed."""
    mine = job.select("id", F.lit(True).alias("mine"))
    return jobs.join(mine, "id", "left").select("id", "kind", F.when(F.col("mine"), "running").otherwise(F.col("state")).alias("state"), (F.col("attempts") + F.coalesce(F.col("mine").cast("int"), F.lit(0))).alias("attempts"))


def after_failure(state: Column, attempts: Column, limit: Column, fatal: Column) -> Column:
    """A failed job waits again until its tries are used up; fatal failures end it at once."""
    return F.when(state != "running", state).when(fatal | (attempts >= limit), "dead").otherwise("queued")


def requeue_stale(jobs: DataFrame) -> DataFrame:
    """After a restart nothing runs: running jobs wait again, or are dead if their tries are used up."""
    state = after_failure(F.col("state"), F.col("attempts"), F.col("max_attempts"), F.lit(False))
    return jobs.withColumn("new_state", state)


def papers_to_fail(jobs: DataFrame) -> DataFrame:
    """Papers with a dead job and none that still waits or runs."""
    dead = jobs.where((F.col("state") == "dead") & F.col("paper_id").isNotNull()).select("paper_id").distinct()
    waiting = jobs.where(F.col("state").isin("queued", "running")).select("paper_id")
    return dead.join(waiting, "paper_id", "left_anti")


def drain_order(jobs: DataFrame) -> DataFrame:
    """Kinds with waiting jobs, in the order they are drained."""
    waiting = with_priority(jobs.where(F.col("state") == "queued"))
    return waiting.groupBy("priority", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy("priority")
