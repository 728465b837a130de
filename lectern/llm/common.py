"""Shared pieces: shared-folder tables, Arrow batches, vectorised words and hashes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import delete, discard, materialize, release, run_dir, scratch, shared_dir, write

__all__ = ["delete", "discard", "materialize", "release", "run_dir", "scratch", "shared_dir", "write"]

#: Separators of words in every contract: the space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
NULL_ID = 2**63 - 1

_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


#: Bits of a filter for each value, and bits of one bitmap (as Spark's bitmap functions have them).
FILTER_BITS, BITMAP_BITS = 16, 32768
#: A filter has at most so many bitmaps of 4 KiB (64 MiB); fuller ones pass more, never less.
MOST_BITMAPS = 1 << 14


def bitmaps_for(values: int) -> int:
    """A power of two of bitmaps with FILTER_BITS bits a value, within the bound."""
    wanted = max(1, values * FILTER_BITS // BITMAP_BITS)
    return min(MOST_BITMAPS, 1 << math.ceil(math.log2(wanted)))


def _slot(value: Column, bitmaps: int) -> tuple[Column, Column]:
    """Which bitmap a value falls into, and which of its bits."""
    h = F.xxhash64(value)
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(bitmaps)).cast("int"), F.pmod(h, F.lit(BITMAP_BITS))


def make_filter(rows: DataFrame, bitmaps: int, column: str = "digest") -> DataFrame:
    """(slot, bits) of a column's values: at most MOST_BITMAPS rows of 4 KiB."""
    slot, bit = _slot(F.col(column), bitmaps)
    return rows.groupBy(slot.alias("slot")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def may_hold(rows: DataFrame, filter_: DataFrame, bitmaps: int, column: str = "digest") -> DataFrame:
    """Adds ``may_hold``: whether the filter may hold a row's value; none that it was made from is denied."""
    slot, bit = _slot(F.col(column), bitmaps)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1
    held = F.broadcast(filter_.select(F.col("slot").alias("_slot"), F.col("bits").alias("_bits")))  # MOST_BITMAPS rows of 4 KiB
    return rows.join(held, slot == F.col("_slot"), "left").withColumn("may_hold", F.coalesce(told, F.lit(False))).drop("_slot", "_bits")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``most`` bytes each; a longer text stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element, on a fresh array."""
    x = x ^ (x >> _U(30))
    x *= _K2
    x ^= x >> _U(27)
    x *= _K3
    x ^= x >> _U(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """Words of many texts: byte ranges, text index and a 64-bit hash of each."""

    __slots__ = ("start", "end", "doc", "first", "hash")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, block: int = 1 << 20):
        n = len(data)
        word = ~_SPACE[data]
        before = np.empty(n, bool)
        if n:
            before[1:] = word[:-1]
            heads = offsets[:-1][offsets[:-1] < n]
            before[heads] = False
            self.start = np.flatnonzero(word & ~before)
            after = np.empty(n, bool)
            after[:-1] = word[1:]
            after[-1] = False
            tails = offsets[1:] - 1
            after[tails[tails >= 0]] = False
            self.end = np.flatnonzero(word & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: first[d] is the index of the first word of text d; first[-1] the number of words.
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = self._hashes(data, lower, block)

    def _hashes(self, data: np.ndarray, lower: bool, block: int, salt: int = 0) -> np.ndarray:
        """A sum over a word's bytes of pseudo-random values of (place, byte), mixed; another salt gives independent hashes."""
        out = np.empty(len(self.start), _U)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + block, "right")))
            sizes = self.end[i:j] - self.start[i:j]
            heads = np.cumsum(sizes) - sizes
            place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(heads, sizes)
            byte = data[place + np.repeat(self.start[i:j], sizes)]
            if lower:
                byte = _LOWER[byte]
            x = (place.astype(_U) << _U(8)) | byte
            x += _U(salt)
            x *= _K1
            x ^= x >> _U(29)
            x *= _K2
            x ^= x >> _U(32)
            out[i:j] = mix(np.add.reduceat(x, heads) + sizes.astype(_U) * _K3)
            i = j
        return out


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its two (overlapping) parts."""
    return mix(left * _K1 + (right ^ _K3) * _K2 + _U(1))


def windows(hashes: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``length`` words inside one text, by doubling, and their first words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    size, h = 1, hashes
    while size < length:
        step = min(size, length - size)
        h = join_hashes(h[: len(h) - step], h[step:])
        size += step
    at = np.flatnonzero(doc[:n] == doc[length - 1 :])
    return h[:n][at], at


def distinct_in_groups(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, value) rows, sorted; groups are small non-negative integers."""
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return g[keep], v[keep]
