"""Substring dedup by level-wise doubling of repeated windows.

Texts are packed into batches, one row each, whose order never changes after.  At every
level each batch names the distinct hashes of its candidate windows; hashes are
dealt out by range, each range finds which of them occur in several documents and answers
every batch with one bit per hash.  Windows repeated at one length alone are
extended to twice that length (clipped to the length asked for on the way there), until no
candidates survive.

The first level, half the window, is thinned: of the half-windows inside a window only
the least by a random order is named.  Equal windows have equal least
half-windows, so none that repeats is lost; a quarter of all places is named.  Of copies
inside one batch only the first document's hashes are sent on, so what a common passage
sends grows with the batches, not with its copies.

What is removed is decided at the second level, by 128 bits: two hashes of a window from two independent
hashes of its words.  Later levels carry the places and hashes of what survived alone, and tell how long a
document's repeats are.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Words, discard, join_hashes, materialize, mix, slices, text_buffers, windows

WINDOW = 13
BATCH_BYTES = 2 << 20
#: Words of all texts per range of hashes: at least, and at most (a range is one task's work).
RANGE_WORDS, MOST_RANGE_WORDS = 2_000_000, 32_000_000
#: Ranges up to which ranges stay small, so that a batch's row per range holds some dozens of hashes.
RANGES = 2_500
#: What makes the second hash of a word another one.
SECOND = 0xA0761D6478BD642F
#: Bytes of a hash that the first level sends; it only thins candidates.
SHORT_HASH = 6
_U = np.uint64


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", batch_bytes: int = BATCH_BYTES, number: str | None = None) -> DataFrame:
    """Rows (batch, n_words, ids, nulls, ends, body): compressed texts of about ``batch_bytes``.

    ``number`` names a column of 64-bit numbers that goes along under its name, without nulls.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("body"), *[number] * (number is not None))
    extra = [number] * (number is not None)

    def run(batches):
        place = TaskContext.get().partitionId() << 32
        ids, numbers, ends, parts, size = [], [], [], [], 0

        def row():
            data = np.concatenate(parts)
            words = int(np.count_nonzero(np.diff((data > 32) | (data < 9) | ((data > 13) & (data < 32)), prepend=False)) // 2 + 1)
            body = pa.compress(data.tobytes(), codec="zstd", asbytes=True)
            offsets = np.concatenate([[0], np.concatenate(ends)]).astype(np.int64)
            known = pa.concat_arrays(ids)
            values = [[place], [words], [known.fill_null(NULL_ID).to_numpy().tobytes()], [np.packbits(known.is_null().to_numpy(zero_copy_only=False)).tobytes()], [offsets.tobytes()], [body], *[[pa.concat_arrays(numbers).to_numpy().tobytes()] for _ in extra]]
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * (4 + len(extra)))
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["batch", "n_words", "ids", "nulls", "ends", "body", *extra])

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            own = batch.column(0)
            for i, j in slices(offsets, batch_bytes):
                if size and size + offsets[j] - offsets[i] > batch_bytes:
                    yield row()
                    place, ids, numbers, ends, parts, size = place + 1, [], [], [], [], 0
                ids.append(own.slice(i, j - i))
                numbers += [batch.column(2).slice(i, j - i) for _ in extra]
                ends.append(offsets[i + 1 : j + 1] - offsets[i] + size)
                parts.append(data[offsets[i] : offsets[j]])
                size += int(offsets[j] - offsets[i])
        if ids:
            yield row()

    return rows.mapInArrow(run, ", ".join(["batch long, n_words long, ids binary, nulls binary, ends binary, body binary", *(f"{c} binary" for c in extra)]))


def _each(table: pa.RecordBatch):
    """Rows as dictionaries, one at a time."""
    for k in range(len(table)):
        yield {name: column[k].as_py() for name, column in zip(table.schema.names, table.columns, strict=True)}


def _bits(column_value) -> dict[str, np.ndarray] | None:
    """Answers to a batch at one level, put together in the order of ranges."""
    if column_value is None:
        return None
    parts = sorted(column_value, key=lambda x: x["range"])
    join = lambda name: np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(x[name], np.uint8), count=x["n"]).astype(bool) for x in parts]])
    return {"repeated": join("repeated"), "later": join("later")}


class Batch:
    """A batch of texts and its candidate windows at each level, replayed from the answers so far."""

    def __init__(self, ids: bytes, ends: bytes, body: bytes):
        offsets = np.frombuffer(ends, np.int64)
        self.raw = pa.decompress(body, int(offsets[-1]), codec="zstd", asbytes=True) if offsets[-1] else b""
        self.ids, self.offsets = np.frombuffer(ids, np.int64), offsets
        self.words = Words(np.frombuffer(self.raw, np.uint8), offsets)
        self.start = np.zeros(0, np.int64)
        self.hash = np.zeros(0, _U)
        self.second: np.ndarray | None = None

    def first_level(self, length: int, window: int) -> None:
        """Candidates are the least half-windows of each window (all of equal ones)."""
        words = self.words
        half, at = windows(words.hash, words.doc, length)
        whole = windows(words.hash, words.doc, window)[1]
        rank = np.full(len(words.hash) + 1, _U(2**64 - 1))
        rank[at] = mix(half ^ _U(0x5851F42D4C957F2D))
        span = window - length + 1
        least = rank[whole]
        for k in range(1, span):
            least = np.minimum(least, rank[whole + k])
        chosen = np.zeros(len(rank), bool)
        for k in range(span):
            chosen[whole[rank[whole + k] == least] + k] = True
        keep = chosen[at]
        self.start, self.hash = at[keep], half[keep]
        self._least, self._rank, self._whole, self._span = least, rank, whole, span

    def survivors(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of windows with a least half-window that is repeated."""
        place = np.searchsorted(np.unique(self.hash), self.hash)
        good = np.zeros(len(self.words.hash) + 1, bool)
        good[self.start[repeated[place]]] = True
        alive = np.zeros(len(self._whole), bool)
        for k in range(self._span):
            alive |= (self._rank[self._whole + k] == self._least) & good[self._whole + k]
        return self._whole[alive]

    def level(self, starts: np.ndarray, length: int) -> None:
        """Candidates are the windows of ``length`` words that begin at ``starts``."""
        hashes, at = windows(self.words.hash, self.words.doc, length)
        place = np.searchsorted(at, starts)
        fits = place < len(at)
        fits[fits] = at[place[fits]] == starts[fits]
        self.start, self.hash = starts[fits], hashes[place[fits]]
        # The second hash, of the words inside candidates alone.
        inside = np.zeros(len(self.words.hash) + 1, np.int64)
        np.add.at(inside, self.start, 1)
        np.add.at(inside, self.start + length, -1)
        inside = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        some = Words.__new__(Words)
        some.start, some.end = self.words.start[inside], self.words.end[inside]
        word = np.zeros(len(self.words.hash), _U)
        word[inside] = some._hashes(np.frombuffer(self.raw, np.uint8), False, 1 << 20, SECOND)
        self.second = np.full(len(self.start), _U(length))
        for k in range(length):
            self.second = mix(self.second * _U(0x9E3779B97F4A7C15) + word[self.start + k])

    def distinct(self) -> Distinct:
        return Distinct(self.hash, self.second, self.ids[self.words.doc[self.start]])

    def replay(self, lengths: list[int], answers: list[dict | None]) -> np.ndarray:
        """Goes through the answered levels (the first at most) and stands at the next one; returns its candidates' starts."""
        self.first_level(lengths[0], lengths[1])
        for answer in answers:
            some = answer is not None and len(answer["repeated"])
            self.level(self.survivors(answer["repeated"]) if some else np.zeros(0, np.int64), lengths[1])
        return self.start


class Distinct:
    """Distinct keys (of one or two hashes, sorted), the index of each row's, the least id of each and whether several ids have it."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None, ids: np.ndarray | None = None):
        self.first, self.place, self.times = np.unique(first, return_inverse=True, return_counts=True)
        self.second = None
        if second is not None:
            self.second = np.zeros(len(self.first), _U)
            self.second[self.place] = second
            if (self.second[self.place] != second).any():  # one first hash, several second ones
                order = np.lexsort((second, first))
                a, b = first[order], second[order]
                head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
                self.first, self.second = a[head], b[head]
                self.place = np.empty(len(order), np.int64)
                self.place[order] = np.cumsum(head) - 1
                self.times = np.bincount(self.place)
        if ids is not None:
            self.low, self.high = np.full(len(self.first), NULL_ID), np.full(len(self.first), np.iinfo(np.int64).min)
            np.minimum.at(self.low, self.place, ids)
            np.maximum.at(self.high, self.place, ids)
            self.several = self.high > self.low


def _planes(values: np.ndarray, size: int) -> bytes:
    """The top ``size`` bytes of 64-bit numbers, one plane of bytes after another; sorted numbers then compress well."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unplanes(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return out.view(">u8").reshape(-1).astype(_U)


NAMED = "range int, batch long, n int, keys binary, seconds binary, several binary, ids binary, which binary"


def _ranges_of(batch: int, found: Distinct, ranges: int, size: int, with_ids: bool) -> pa.RecordBatch:
    """Rows (range, batch, n, keys, seconds, several, ids, which) of a batch's distinct keys."""
    part = ((found.first >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
    cuts = np.searchsorted(part, np.arange(ranges + 1))
    rows = []
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        a, b = cuts[r], cuts[r + 1]
        ids, which = np.unique(found.low[a:b], return_inverse=True) if with_ids else (np.zeros(0, np.int64),) * 2
        packed = which.astype("<u2" if len(ids) < 65536 else "<u4").tobytes()
        seconds = b"" if found.second is None else found.second[a:b].tobytes()
        rows.append((r, batch, int(b - a), _planes(found.first[a:b], size), seconds, np.packbits(found.several[a:b]).tobytes(), ids.tobytes(), packed))
    kinds = (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=[c.split()[0] for c in NAMED.split(", ")])


def _named(lengths: list[int], level: int, ranges: int):
    """For each batch: its distinct candidates, by range."""

    def run(batches):
        for table in batches:
            for row in _each(table):
                batch = Batch(row["ids"], row["ends"], row["body"])
                batch.replay(lengths[:2], [_bits(row["a0"])] if level else [])
                if len(batch.start):
                    yield _ranges_of(row["batch"], batch.distinct(), ranges, SHORT_HASH if level == 0 else 8, level > 0)

    return run


def _binaries(column: pa.ChunkedArray) -> list[memoryview]:
    """Values of a binary column without copies."""
    data, offsets = text_buffers(column)
    view = memoryview(data)
    return [view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _answered(size: int, with_ids: bool):
    """For one range: which keys occur in several documents, and which in one with a smaller id."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        n = table["n"].to_numpy()
        keys = np.concatenate([_unplanes(x, size) for x in _binaries(table["keys"])])
        seconds = np.frombuffer(text_buffers(table["seconds"])[0].tobytes(), _U)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k).astype(bool) for x, k in zip(_binaries(table["several"]), n.tolist(), strict=True)])
        own = None
        if with_ids:
            own = np.concatenate([np.frombuffer(x, np.int64)[np.frombuffer(w, "<u2" if len(x) < 8 * 65536 else "<u4")] for x, w in zip(_binaries(table["ids"]), _binaries(table["which"]), strict=True)])
        found = Distinct(keys, seconds if len(seconds) else None, own)
        shared = np.zeros(len(found.first), bool)
        shared[found.place[several]] = True
        if with_ids:
            repeated, later = (found.several | shared)[found.place], own > found.low[found.place]
        else:
            repeated, later = ((found.times > 1) | shared)[found.place], np.zeros(len(keys), bool)
        ends = np.cumsum(np.r_[0, n]).tolist()
        pieces = [(np.packbits(repeated[a:b]).tobytes(), np.packbits(later[a:b]).tobytes(), int(repeated[a:b].sum())) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        kinds = (pa.binary(), pa.binary(), pa.int32())
        columns = {name: pa.array([p[k] for p in pieces], t) for k, (name, t) in enumerate(zip(("repeated", "later", "hits"), kinds, strict=True))}
        return pa.table({"batch": table["batch"], "range": table["range"], "n": table["n"], **columns})

    return run


def _ask(named: DataFrame, size: int, with_ids: bool, name: str) -> DataFrame:
    """The ranges' answers to named candidates, as a table."""
    answers = named.groupBy("range").applyInArrow(_answered(size, with_ids), "batch long, range int, n int, repeated binary, later binary, hits int")
    return materialize(answers, f"substring-{name}")


def _told(state: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Batches with the answers to each.  Both sides are dealt out by batch at any size."""
    per_batch = answers.groupBy("batch").agg(F.collect_list(F.struct("range", "n", "repeated", "later")).alias(name))
    return state.join(per_batch.hint("merge"), "batch", "left")


#: What survived a level: first word of each text, places and hashes of repeated windows, the longest repeat of each text so far.
SURVIVORS = "batch long, first binary, start binary, hash binary, longest binary"


def _first_survivors(lengths: list[int]):
    """Places whose windows of the second length are repeated."""

    def run(batches):
        for table in batches:
            for row in _each(table):
                batch = Batch(row["ids"], row["ends"], row["body"])
                batch.replay(lengths[:2], [_bits(row["a0"])])
                longest = np.zeros(len(batch.ids), np.int32)
                if len(batch.start):
                    alive = _bits(row["a1"])["repeated"][batch.distinct().place]
                    batch.start, batch.hash = batch.start[alive], batch.hash[alive]
                    longest[batch.words.doc[batch.start]] = lengths[1]
                yield _survivor_row(row["batch"], batch.words.first.tobytes(), batch.start, batch.hash, longest)

    return run


def _survivor_row(batch: int, first: bytes, start: np.ndarray, hashes: np.ndarray, longest: np.ndarray) -> pa.RecordBatch:
    values = ([batch], [first], [start.astype(np.int32).tobytes()], [hashes.tobytes()], [longest.tobytes()])
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == 0 else pa.binary()) for k, v in enumerate(values)], names=[c.split()[0] for c in SURVIVORS.split(", ")])


def _doubled(row: dict, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and texts of windows of twice ``length`` whose halves both survived."""
    start, hashes, first = np.frombuffer(row["start"], np.int32).astype(np.int64), np.frombuffer(row["hash"], _U), np.frombuffer(row["first"], np.int64)
    if not len(start):
        return start, hashes, start
    place = np.minimum(np.searchsorted(start, start + length), len(start) - 1)
    doc = np.searchsorted(first, start, "right") - 1
    at = np.flatnonzero((start[place] == start + length) & (doc[place] == doc))
    return start[at], join_hashes(hashes[at], hashes[place[at]]), doc[at]


def _named_doubled(length: int, ranges: int):
    def run(batches):
        for table in batches:
            for row in _each(table):
                start, hashes, doc = _doubled(row, length)
                if len(start):
                    yield _ranges_of(row["batch"], Distinct(hashes, None, doc), ranges, 8, False)

    return run


def _next_survivors(length: int):
    def run(batches):
        for table in batches:
            for row in _each(table):
                start, hashes, doc = _doubled(row, length)
                longest = np.frombuffer(row["longest"], np.int32).copy()
                if len(start):
                    alive = _bits(row["level"])["repeated"][np.unique(hashes, return_inverse=True)[1]]
                    start, hashes = start[alive], hashes[alive]
                    longest[doc[alive]] = 2 * length
                yield _survivor_row(row["batch"], row["first"], start, hashes, longest)

    return run


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, exhaust: bool = True) -> tuple[DataFrame, list[int]]:
    """(id, n_words, n_removed, removed, longest_repeat, kept_text) per row, and the lengths whose windows were compared.

    Words are maximal runs without separators; a word is removed if it lies in a window of
    ``window`` words that also begins in a row with a smaller id.  ``removed`` holds
    the removed ranges of words [from, to); kept words are joined by one space.  Texts
    shorter than the window, null (no words) and empty ones lose nothing.  A null id counts as 2**63 - 1: it is
    larger than any other and equal to other nulls; rows that repeat an id never remove each other's words.
    A very long text is a batch of its own, with some hundred bytes of memory a word.
    Extra columns are ignored; an empty table gives an empty result.

    With ``exhaust`` the levels go on past ``window`` until no windows are repeated: the
    last length is the longest that was tried.  ``longest_repeat`` is the greatest of the lengths at which a window of the row also
    stands in another row (at ``window`` itself: in a row of another id; 0 for none): its longest repeat has that many words, and less than twice as many.  Without
    ``exhaust`` it is ``window`` or 0.
    """
    half = max(1, -(-window // 2))
    lengths = [half, window] if window > 1 else [1, 1]
    packed = materialize(pack(docs.select(id_column, text_column), id_column, text_column), "substring-packed")
    total = packed.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(1, min(-(-int(total) // RANGE_WORDS), RANGES), -(-int(total) // MOST_RANGE_WORDS))

    state = packed
    for level in (0, 1):
        named = state.mapInArrow(_named(lengths, level, ranges), NAMED)
        answers = _ask(named, SHORT_HASH if level == 0 else 8, level > 0, f"answers-{level}")
        state = _told(state, answers, f"a{level}")
    last, length = materialize(state.mapInArrow(_first_survivors(lengths), SURVIVORS), "substring-survivors"), window
    while exhaust and not answers.where("hits > 0").isEmpty():
        answers = _ask(last.mapInArrow(_named_doubled(length, ranges), NAMED), 8, False, "answers-level")
        fresh = materialize(_told(last, answers, "level").mapInArrow(_next_survivors(length), SURVIVORS), "substring-survivors")
        discard(last)
        last, length = fresh, 2 * length
        lengths = [*lengths, length]
    longest = materialize(last.select("batch", "longest"), "substring-longest")
    discard(last)
    found = state.join(longest.hint("merge"), "batch", "left")
    return found.mapInArrow(_applied(lengths, window), "id long, n_words long, n_removed long, removed string, longest_repeat long, kept_text string"), lengths


def _applied(lengths: list[int], window: int):
    names = ["id", "n_words", "n_removed", "removed", "longest_repeat", "kept_text"]

    def run(batches):
        for table in batches:
            for row in _each(table):
                batch = Batch(row["ids"], row["ends"], row["body"])
                answers = [_bits(row[f"a{k}"]) for k in range(2)]
                batch.replay(lengths[:2], answers[:1])
                words = batch.words
                change = np.zeros(len(words.hash) + window + 1, np.int64)
                if len(batch.start):
                    found = batch.distinct()
                    gone = batch.start[answers[1]["later"][found.place] | (batch.ids[words.doc[batch.start]] > found.low[found.place])]
                    np.add.at(change, gone, 1)
                    np.add.at(change, gone + window, -1)
                covered = np.cumsum(change)[: len(words.hash)] > 0
                counts = np.diff(words.first)
                total = np.concatenate([[0], np.cumsum(covered)])
                removed = total[words.first[1:]] - total[words.first[:-1]]
                kept, spans = [], []
                for d, (a, b) in enumerate(zip(batch.offsets[:-1].tolist(), batch.offsets[1:].tolist(), strict=True)):
                    own = batch.raw[a:b].split()
                    if removed[d]:
                        mask = covered[words.first[d] : words.first[d + 1]]
                        edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                        spans.append(",".join(f"{x}:{y}" for x, y in edges.reshape(-1, 2).tolist()))
                        own = compress(own, (~mask).tolist())
                    else:
                        spans.append("")
                    kept.append(b" ".join(own))
                nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(batch.ids)).astype(bool)
                ids = pa.array(batch.ids, mask=nulls)
                text = pa.array(kept, pa.binary()).cast(pa.string())
                longest = pa.array(np.frombuffer(row["longest"], np.int32).astype(np.int64))
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(removed), pa.array(spans, pa.string()), longest, text], names=names)

    return run
