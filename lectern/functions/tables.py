"""Tables in the folder that the driver and all executors share: what rounds are cut by."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of applications of a local master that name none.
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Where the session has neither, a folder of this machine serves a local master alone, one for each application; a cluster's
    executors wouldn't see each other's files there, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        found = context._jsc.sc().getCheckpointDir() if hasattr(context, "_jsc") else None
        if found is None or found.isEmpty():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return found.get().rstrip("/")
    if context.applicationId not in _FOLDERS:
        _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="lectern-")
    return _FOLDERS[context.applicationId]


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; other applications' tables stand beside it."""
    return f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}"


#: Spark removes an execution's shuffle files when it ends, where this is set.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Writes under way of each session, and its setting before the first of them.
_WRITING: dict[int, tuple[int, str]] = {}
_LOCK = threading.Lock()


def write(df: DataFrame, path: str, **options: str) -> None:
    """Writes a table as Parquet.  Its shuffle files go with the write: whoever needs the rows again reads the table.

    The setting is the session's: other executions that run in it at the same time lose their shuffle files at their end, too.
    """
    session, conf = id(df.sparkSession), df.sparkSession.conf
    with _LOCK:
        n, before = _WRITING.get(session) or (0, conf.get(_CLEAN_UP, "false"))
        _WRITING[session] = (n + 1, before)
        conf.set(_CLEAN_UP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        with _LOCK:
            n, before = _WRITING[session]
            if n > 1:
                _WRITING[session] = (n - 1, before)
            else:
                del _WRITING[session]
                conf.set(_CLEAN_UP, before)


#: Tables of the open scopes of this thread, innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    Cuts the lineage: a lost executor costs nothing that was written before.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    write(df, path, **options)
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def settled(df: DataFrame) -> DataFrame:
    """As materialize, between rounds: plans of later rounds don't grow with earlier ones."""
    return materialize(df, "rounds")


def discard(table: DataFrame) -> None:
    """Removes a table that ``materialize`` gave, once nothing that reads it is still to be computed."""
    delete(table.sparkSession, table.written_at)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``materialize`` writes inside go at the end, but for those written by the function it yields.

    Nothing that is still to be computed may read the others then.
    """
    scopes = _SCOPES.get()
    outer, own = scopes[-1] if scopes else [], []
    token = _SCOPES.set((*scopes, own))

    def keep(df: DataFrame, name: str) -> DataFrame:
        table = materialize(df, name)
        own.remove(table.written_at)
        outer.append(table.written_at)
        return table

    try:
        yield keep
    finally:
        _SCOPES.reset(token)
        for path in own:
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Removes the tables that this application's operators wrote, once no result that reads them is needed any more."""
    delete(spark, run_dir(spark))
