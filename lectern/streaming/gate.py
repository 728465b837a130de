"""The citation gate over answers that arrive in pieces.

A mark [#id] may be cut between two pieces, so what could be the beginning of one is held back until it is whole or can't
become one: at most an opening bracket, a hash and the digits of an id, so ten characters with ids of up to seven digits.  All other text passes at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Digits of the longest id; what has more is no mark.
MOST_DIGITS = 18
_MARK = re.compile(r"\[#([0-9]{1,%d})\]" % MOST_DIGITS)
_BEGUN = re.compile(r"\[(?:#[0-9]*)?\Z")


def checked(text: str, allowed: set[int]) -> tuple[str, list[int], list[int]]:
    """The text without marks of ids that aren't allowed, and the ids of both kinds, in order."""
    kept, refused = [], []

    def judge(m: re.Match) -> str:
        ok = int(m[1]) in allowed
        (kept if ok else refused).append(int(m[1]))
        return m[0] if ok else ""

    return _MARK.sub(judge, text), kept, refused


def held_from(text: str) -> int:
    """Where a mark may have begun that the text doesn't end; the text's length if none has."""
    m = _BEGUN.search(text)
    return m.start() if m and m.end() - m.start() <= MOST_DIGITS + 2 else len(text)


class _Gate(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "text string, allowed array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.held.get()
        text, allowed = (before[0], set(before[1])) if before is not None else ("", set())
        pieces = pd.concat(rows).sort_values("place")
        for ids in pieces["allowed"]:
            allowed |= set(map(int, ids)) if ids is not None else set()
        text += "".join(x for x in pieces["token"] if x is not None)
        over = bool(pieces["last"].any())
        cut = len(text) if over else held_from(text)
        clean, kept, refused = checked(text[:cut], allowed)
        if over:
            self.held.clear()
        else:
            self.held.update((text[cut:], sorted(allowed)))
        yield pd.DataFrame({"answer": [key[0]], "place": [int(pieces["place"].max())], "text": [clean], "cited": [kept], "refused": [refused], "over": [over]})

    def close(self) -> None:
        pass


def gated(tokens: DataFrame) -> DataFrame:
    """(answer, place, text, cited, refused, over): for each answer and batch the text that may be shown by now.

    ``tokens`` (answer, place, token, allowed, last), a stream or a table: pieces of an answer come in the order of their places, batch after batch;
    ``allowed`` ids (null: no more) hold from then on; ``last`` ends the answer.  However an answer is cut, its texts one after the other, and its
    ids, are what the gate gives for the whole of it.  The session needs the state store of RocksDB (``settle.with_state_store``).
    """
    return tokens.select("answer", "place", "token", "allowed", "last").groupBy("answer").transformWithStateInPandas(
        statefulProcessor=_Gate(), outputStructType="answer string, place long, text string, cited array<long>, refused array<long>, over boolean", outputMode="Append", timeMode="None"
    )
