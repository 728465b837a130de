"""Files that have come to rest, from a stream of changes: a timer per path, set anew by every change.

Once nothing came for ``debounce`` seconds the file's size is read every ``poll`` seconds, until it is the same twice running (and not zero).
A file that is gone by then is dropped; one that still changes after ``tries`` reads is given up, until it changes again.
State and timers are Spark's, per path, so a restarted query goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds without a change, seconds between two reads of a size, and reads at most.
DEBOUNCE, POLL, TRIES = 2.0, 1.0, 30
SETTLED, VANISHED, GIVEN_UP = "settled", "vanished", "given up"


def size_of(path: str) -> int | None:
    """A file's size on any file system that Arrow knows; none if there is no such file."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = system.get_file_info(name)
    return found.size if found.type == fs.FileType.File else None


def judged(size: int | None, before: int | None, tries: int, most: int = TRIES) -> str | None:
    """What one more read of a size tells; none: read again."""
    if size is None:
        return VANISHED
    if size > 0 and size == before:
        return SETTLED
    return GIVEN_UP if tries >= most else None


class _Settle(StatefulProcessor):
    def __init__(self, debounce: float, poll: float, tries: int, size_of: Callable[[str], int | None]):
        self.debounce, self.poll, self.tries, self.size_of = int(debounce * 1000), int(poll * 1000), tries, size_of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("read", "size long, tries int")

    def _restart(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for _ in rows:  # what changed doesn't matter, only when
            pass
        self.state.update((None, 0))
        self._restart(timerValues.getCurrentProcessingTimeInMs() + self.debounce)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.state.get()
        before, tries = (found[0], found[1]) if found is not None else (None, 0)
        size = self.size_of(key[0])
        outcome = judged(size, before, tries + 1, self.tries)
        if outcome is None:
            self.state.update((size, tries + 1))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.poll)
            return
        self.state.clear()
        yield pd.DataFrame({"path": [key[0]], "outcome": [outcome], "size": pd.array([size], "Int64"), "tries": [tries + 1]})

    def close(self) -> None:
        pass


def settled_files(changes: DataFrame, debounce: float = DEBOUNCE, poll: float = POLL, tries: int = TRIES, size: Callable[[str], int | None] = size_of) -> DataFrame:
    """(path, outcome, size, tries) of every path of a stream of changes (``path``), once it is settled, vanished or given up.

    Null paths are dropped.  The session needs the state store of RocksDB (``with_state_store``).
    """
    rows = changes.where("path IS NOT NULL").select("path")
    return rows.groupBy("path").transformWithStateInPandas(statefulProcessor=_Settle(debounce, poll, tries, size), outputStructType="path string, outcome string, size long, tries int", outputMode="Append", timeMode="ProcessingTime")


def with_state_store(spark) -> None:
    """Sets the state store that timers and typed state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
