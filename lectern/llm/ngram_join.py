"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Two sets of n and m elements whose similarity is at least ``share`` percent hold at least
c(n, m) = ceil(share * (n + m) / (100 + share)) elements in common.

*Light* sets (at most x elements) are joined by subsets: each enumerates its subsets of every
size c that it may have to share with a set of a possible size, so two linked light sets
name one subset alike.

*Heavy* sets are joined by inverted lists: elements are ordered by the number of documents that hold them, rare ones first,
and a set scans the lists of its first n - ceil(share * n / 100) + 1 elements alone; two linked sets meet in one of them.
Lists also hold the light sets that a heavy one may be linked with.

The boundary x is the one of least cost, by the sizes at hand: subsets to enumerate below it, entries of lists to scan above it.

How many documents hold an element is counted exactly, without a row per element: texts are packed into
batches, each batch sends its distinct hashes to the ranges they fall into, with the number of documents, and gets one byte
back for each.  The byte grows with the count; any order that all sets share gives right results.

Sets that meet in a subset or a list are compared exactly, as near-duplicates are: all of them with the least, and
those that aren't in its component with all others, in blocks.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, scratch, text_buffers
from .minhash import numbered, set_digests, shingle_sets, with_components
from .substring_dedup import _binaries, _each, _planes, _unplanes, pack

SHINGLE, SHARE = 5, 80
#: Sets of more elements are heavy: at 80 percent, one of 15 would have over 450 subsets, one of 14 has 106.
MOST_LIGHT = 14
#: Words of all texts in one range of hashes, about.
RANGE_WORDS = 2_000_000
#: Bytes of a hash by which documents are counted; elements that share them count together.
COUNTED_BYTES = 6
_U = np.uint64
_LIST, _SUBSET = _U(0x8CB92BA72F3D8DD7), _U(0xD6E8FEB86659FD93)


def prefix(n, share: int = SHARE):
    """Elements of a set of n whose lists it scans."""
    return n - -(-share * n // 100) + 1


def overlaps(n: int, share: int = SHARE) -> list[int]:
    """The numbers of elements that a set of n may have to share with one of a possible size."""
    return sorted({-(-share * (n + m) // (100 + share)) for m in range(-(-share * n // 100), 100 * n // share + 1)})


def subsets(n: int, share: int = SHARE) -> int:
    return sum(comb(n, c) for c in overlaps(n, share))


def subset_keys(sets: np.ndarray, share: int = SHARE) -> np.ndarray:
    """Keys of the subsets that sets of one size (rows of hashes) enumerate: one row of keys for each set."""
    keys = []
    for c in overlaps(sets.shape[1], share):
        picks = np.array(list(combinations(range(sets.shape[1]), c)))
        keys.append(mix(mix(sets ^ _SUBSET)[:, picks].sum(axis=2) + _U(c)))
    return np.concatenate(keys, axis=1)


def count_class(documents: np.ndarray) -> np.ndarray:
    """One byte that grows with a number of documents: exact up to 127, then eight steps per doubling."""
    above = 128 + np.floor(8 * np.log2(np.maximum(documents, 128) / 128)).astype(np.int64)
    return np.where(documents < 128, documents, np.minimum(above, 255)).astype(np.uint8)


def list_keys(group: np.ndarray, hashes: np.ndarray, classes: np.ndarray, sizes: np.ndarray, share: int = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(set, element) for the lists that each set scans: of its first elements by (class, hash), those that other documents hold too."""
    alone = np.bincount(group[classes < 2], minlength=len(sizes))
    left = np.maximum(prefix(sizes, share) - alone, 0)
    at = np.flatnonzero((classes >= 2) & (left[group] > 0))
    at = at[np.lexsort((hashes[at], classes[at], group[at]))]
    heads = np.flatnonzero(np.r_[True, group[at][1:] != group[at][:-1]]) if len(at) else at
    place = np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)]))
    at = at[place < left[group[at]]]
    return group[at], at


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ends = np.frombuffer(row["ends"], np.int64)
    raw = pa.decompress(row["body"], int(ends[-1]), codec="zstd", asbytes=True) if ends[-1] else b""
    return np.frombuffer(raw, np.uint8), ends


_COUNTED = "range int, batch long, n int, keys binary, documents binary"


def _named(ranges: int, size: int):
    """For each batch: its distinct hashes by range, with the number of its documents that hold each (255 stands for more)."""

    def run(batches):
        for table in batches:
            for row in _each(table):
                hashes, documents = np.unique(shingle_sets(*_texts(row), size)[1], return_counts=True)
                cuts = np.searchsorted(((hashes >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64), np.arange(ranges + 1))
                some = np.flatnonzero(np.diff(cuts))
                few = np.minimum(documents, 255).astype(np.uint8)
                columns = [some, np.full(len(some), row["batch"]), np.diff(cuts)[some]]
                parts = [[_planes(hashes[a:b], COUNTED_BYTES) for a, b in zip(cuts[some], cuts[some + 1], strict=True)], [few[a:b].tobytes() for a, b in zip(cuts[some], cuts[some + 1], strict=True)]]
                arrays = [pa.array(c, k) for c, k in zip([*columns, *parts], (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _COUNTED.split(", ")])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """For one range: the class of each batch's hashes, by the documents of all batches."""
    table = table.sort_by("batch")
    n = table["n"].to_numpy()
    keys = np.concatenate([_unplanes(x, COUNTED_BYTES) for x in _binaries(table["keys"])])
    documents = np.frombuffer(text_buffers(table["documents"])[0].tobytes(), np.uint8)
    _, place = np.unique(keys, return_inverse=True)
    classes = count_class(np.bincount(place, weights=documents))[place]
    ends = np.cumsum(np.r_[0, n])
    answers = [pa.compress(classes[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.table({"batch": table["batch"], "range": table["range"], "n": table["n"], "classes": pa.array(answers, pa.binary())})


_SIGNED = "id long, n_shingles long, d0 long, d1 long, light array<long>, heavy array<long>, scanned long, at long, key int"


def _lists(starts: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _signed(size: int, share: int):
    """For each text: its size, the digest of its set, subsets if it may be light, lists to scan and how many documents are in them."""

    def run(batches):
        for table in batches:
            for row in _each(table):
                group, hashes = shingle_sets(*_texts(row), size)
                n = len(row["ends"]) // 8 - 1
                sizes = np.bincount(group, minlength=n)
                parts = sorted(row["answers"] or [], key=lambda x: x["range"])
                classes = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(pa.decompress(x["classes"], x["n"], codec="zstd", asbytes=True), np.uint8) for x in parts]])
                classes = classes[np.unique(hashes, return_inverse=True)[1]] if len(hashes) else classes
                owner, at = list_keys(group, hashes, classes, sizes, share)
                heavy, scanned = mix(hashes[at] ^ _LIST), np.bincount(owner, weights=classes[at], minlength=n).astype(np.int64)
                cuts = np.searchsorted(group, np.arange(n + 1))
                light, counts = [], np.zeros(n, np.int64)
                for k in range(1, MOST_LIGHT + 1):
                    own = np.flatnonzero(sizes == k)
                    if len(own):
                        keys = subset_keys(hashes[cuts[own][:, None] + np.arange(k)], share)
                        counts[own] = keys.shape[1]
                        light.append((own, keys))
                starts = np.r_[0, np.cumsum(counts)]
                flat = np.zeros(int(starts[-1]), _U)
                for own, keys in light:
                    flat[starts[own][:, None] + np.arange(keys.shape[1])] = keys
                digest = set_digests(group, hashes, n)
                nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=n).astype(bool)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=nulls)
                at_ = pa.array(np.frombuffer(row["at"], np.int64))
                columns = [ids, pa.array(sizes), pa.array(digest[0]), pa.array(digest[1]), _lists(starts, flat), _lists(np.searchsorted(owner, np.arange(n + 1)), heavy), pa.array(scanned), at_, pa.array(np.zeros(n, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SIGNED.split(", ")])

    return run


def boundary(costs: dict[int, tuple[int, int]], share: int = SHARE) -> int:
    """The largest size of a light set: least subsets of those up to it, and entries of lists of those that may meet larger ones.

    ``costs`` has the subsets and the list entries of all sets of each size up to MOST_LIGHT.
    """

    def cost(x: int) -> int:
        least = -(-share * (x + 1) // 100)
        return sum(a * (n <= x) + b * (n >= least) for n, (a, b) in costs.items())

    return min(range(MOST_LIGHT + 1), key=cost)


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: int = SHARE, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links lead to, its own included).

    Sets hold the distinct shingles of ``shingle`` words, A-Z in lower case; a text of fewer words is one shingle; texts without
    words (null, empty) have none and are linked with nothing.  Documents link when 100 * |intersection| >= share * |union|, by
    64-bit hashes of their shingles.  Null ids come last: a component_id is null only where all ids of the component are.  Rows that repeat
    an id are judged by their own texts, those of equal texts are one class and cost one comparison.  A very long
    text is a batch of its own.  Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    if not 50 < share <= 100:
        raise ValueError("share must be above 50 and at most 100")
    rows = numbered(docs, id_column, text_column)
    with scratch(docs.sparkSession) as keep:
        packed = materialize(pack(rows.select("id", "body", "at"), "id", "body", number="at"), "join-packed")
        total = packed.agg(F.sum("n_words")).first()[0] or 0
        ranges = max(1, -(-int(total) // RANGE_WORDS))
        named = packed.mapInArrow(_named(ranges, shingle), _COUNTED)
        answers = materialize(named.groupBy("range").applyInArrow(_counted, "batch long, range int, n int, classes binary"), "join-counted")
        told = answers.groupBy("batch").agg(F.collect_list(F.struct("range", "n", "classes")).alias("answers"))
        signed = keep(packed.join(told.hint("merge"), "batch", "left").mapInArrow(_signed(shingle, share), _SIGNED), "join-signed")
    light = F.col("n_shingles") <= MOST_LIGHT
    found = signed.where(light & (F.col("n_shingles") > 0)).groupBy("n_shingles").agg(F.sum(F.size("light")).alias("a"), F.sum("scanned").alias("b")).collect()
    x = boundary({r.n_shingles: (r.a, r.b) for r in found}, share)
    none = F.array().cast("array<long>")
    keys = F.concat(F.when(F.col("n_shingles") <= x, F.col("light")).otherwise(none), F.when(F.col("n_shingles") >= -(-share * (x + 1) // 100), F.col("heavy")).otherwise(none))
    out = with_components(signed.withColumn("bands", keys), rows, share, shingle)
    return out.select("id", "n_shingles", "component_id")
