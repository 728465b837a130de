"""MinHash near-dedup: SuperMinHash signatures, banding, exact verification, components.

Documents with the same set of shingles form one class, told by a 128-bit digest of
the set; everything after that works on one document of each class, under a number that the class
alone has.  Sets are compared by the 64-bit hashes of their shingles.

SuperMinHash (Ertl 2017): element e puts r_j(e) + j into register p_j(e), where p(e) is a
random permutation of the registers, and a register keeps its least value.  Since a
value of step j is at least j, a document stops after the first step that leaves no
register empty (early stopping): most need one or two.  Ranks of one element exclude each other,
so estimates vary less than those of independent minima, most of all for small sets.

Bands of three registers, 24 of them: two documents at similarity 0.8 share no
band with probability (1 - 0.8^3)^24 < 4e-8.  Documents of a band's bucket are
compared with its least one, the centre; those that aren't in its component are compared with all
others that met the same one, blocks of them against blocks of all, so no pair of a bucket stays unseen and no
group is gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, bitmaps_for, distinct_in_groups, make_filter, materialize, may_hold, mix, scratch, slices, text_buffers, windows
from .graph import connected_components

REGISTERS, ROWS = 72, 3
BANDS = REGISTERS // ROWS
SHINGLE, SHARE = 4, 80
BATCH_BYTES = 1 << 20
#: Shingles and documents of one block of documents that are compared with another one, about.
BLOCK_SHINGLES, BLOCK_ROWS = 120_000, 600
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash) of lower-cased texts; a text of fewer words is one shingle."""
    words = Words(data, offsets, lower=True)
    hashes, at = windows(words.hash, words.doc, size)
    group = words.doc[at]
    counts = np.diff(words.first)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            first = words.first[short]
            h = words.hash[first]
            for k in range(1, n):
                h = mix(h * _U(0x9E3779B97F4A7C15) + words.hash[first + k])
            group = np.concatenate([group, short])
            hashes = np.concatenate([hashes, mix(h + _U(n))])
    return distinct_in_groups(group, hashes)


def superminhash(group: np.ndarray, hashes: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (n, registers) of sets given as rows (group, hash), sorted by group; each set has an element.

    At most 256 registers: a step number takes one byte of a value.
    """
    if not 0 < registers <= 256:
        raise ValueError("1 to 256 registers")
    m, full = registers, _U(2**64 - 1)
    out = np.full(n * m, full)
    swaps: np.ndarray | None = None
    g, h = group, hashes
    for step in range(m):
        seed = mix(h + _U((step + 1) * 0xD1B54A32D192ED03 % 2**64))
        draw = step + ((seed >> _U(32)) % _U(m - step)).astype(np.int64)
        if step == 0:
            register = draw
        else:
            if swaps is None:
                swaps = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
                first = ((mix(h + _U(0xD1B54A32D192ED03)) >> _U(32)) % _U(m)).astype(np.int64)
                row = np.arange(len(h))
                swaps[:, 0], swaps[row, first] = swaps[row, first], swaps[:, 0].copy()
            row = np.arange(len(h))
            register = swaps[row, draw].astype(np.int64)
            swaps[row, draw] = swaps[:, step]
            swaps[:, step] = register
        value = (mix(seed + _U(0x632BE59BD9B4E019)) >> _U(8)) | _U(step) << _U(56)
        np.minimum.at(out, g * m + register, value)
        table = out.reshape(n, m)
        open_ = (table[:, :] == full).any(axis=1)
        if not open_.any():
            break
        stay = open_[g]
        if not stay.all():
            g, h = g[stay], h[stay]
            swaps = swaps[stay] if swaps is not None else None
    return out.reshape(n, m)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, m = signatures.shape
    parts = signatures.reshape(n, m // rows, rows)
    key = np.broadcast_to(np.arange(m // rows, dtype=_U), parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _U(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def set_digests(group: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit sums per set that don't depend on order; zero for empty sets."""
    digest = np.zeros((2, n), _U)
    if len(group):
        heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            digest[k, group[heads]] = np.add.reduceat(mix(hashes + _U(salt)), heads)
    return digest.view(np.int64)


def _signed(size: int):
    """id, n_shingles, a digest of the set in two numbers, the keys of all bands, and what else the rows carry."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, BATCH_BYTES):
                group, hashes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                counts = np.bincount(group, minlength=j - i)
                some = np.flatnonzero(counts)
                keys = np.zeros((j - i, BANDS), np.int64)
                digest = set_digests(group, hashes, j - i)
                if len(some):
                    keys[some] = band_keys(superminhash(np.searchsorted(some, group), hashes, len(some)))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(counts), pa.array(digest[0]), pa.array(digest[1]), bands, *(c.slice(i, j - i) for c in batch.columns[2:])], names=["id", "n_shingles", "d0", "d1", "bands", "at", "key"])

    return run


def _as_sets(size: int):
    """The digest of a text's set and the sorted hashes of its shingles, packed."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in slices(offsets, BATCH_BYTES):
                group, hashes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                cuts = np.searchsorted(group, np.arange(j - i + 1))
                packed = [hashes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                digest = set_digests(group, hashes, j - i)
                yield pa.RecordBatch.from_arrays([pa.array(digest[0]), pa.array(digest[1]), pa.array(packed, pa.binary())], names=["d0", "d1", "shingles"])

    return run


def _linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    low, high = sorted((len(a), len(b)))
    if 100 * low < share * high:
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= share * (len(both) - same)


def _verify(share: int):
    def run(batches):
        for batch in batches:
            ok = [_linked(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U), share) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_())), batch.column(1).filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return run


def _compare_blocks(share: int):
    """Links between components: documents of one block (side 0) against those of another (side 1)."""

    def run(table: pa.Table) -> pa.Table:
        comp, side = table["component"].to_numpy(), table["side"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), _U) for x in table["shingles"]]
        sizes = np.array([len(x) for x in sets])
        rows, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found: set[tuple[int, int]] = set()
        if len(rows) and len(other):
            flat = np.concatenate([sets[k] for k in other])
            owner = np.repeat(np.arange(len(other)), sizes[other])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for k in rows:
                low, high = np.searchsorted(flat, sets[k], "left"), np.searchsorted(flat, sets[k], "right")
                counts = high - low
                at = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
                same = np.bincount(owner[at], minlength=len(other))
                hit = (100 * same >= share * (sizes[k] + sizes[other] - same)) & (comp[other] != comp[k])
                found.update((max(int(comp[k]), c), min(int(comp[k]), c)) for c in np.unique(comp[other[hit]]).tolist())
        links = sorted(found)
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", share: int = SHARE, key: Column | None = None, shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (id = component_id), and ``key`` if given.

    Sets hold the distinct shingles of ``shingle`` lower-cased words; shorter texts are one
    shingle; texts without words (null, empty) have none and are linked with nothing.
    Documents link when 100 * |intersection| >= share * |union|, on the full sets.
    Null ids come last: a group's component_id is null only if all its ids are, and then all
    its rows are kept.  Rows that repeat an id are judged by their own texts; of rows that repeat
    id and text all carry the same result.  A very long text is one set as others are, in memory by itself.  Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = numbered(docs, id_column, text_column, key)
    kind = dict(rows.dtypes)["key"]
    signed = materialize(rows.mapInArrow(_signed(shingle), f"id long, n_shingles long, d0 long, d1 long, bands array<long>, at long, key {kind}"), "near-signed")
    out = with_components(signed, rows, share, shingle)
    return out.select("id", "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), *["key"] * (key is not None))


def numbered(docs: DataFrame, id_column: str, text_column: str, key: Column | None = None) -> DataFrame:
    """id, body, at: a hash of both that finds a row again, whatever ids repeat or are null, and key."""
    ident, body = F.col(id_column).cast("long"), F.col(text_column).cast("string")
    return docs.select(ident.alias("id"), body.alias("body"), F.xxhash64(ident, body).alias("at"), (F.lit(0) if key is None else key).alias("key"))


def with_components(signed: DataFrame, rows: DataFrame, share: int, shingle: int) -> DataFrame:
    """``signed`` (id, n_shingles, d0, d1, bands: keys one of which any two linked sets share, at, key) as id, n_shingles, key, component_id.

    ``rows`` holds the texts under the same ``at``.
    """
    with scratch(signed.sparkSession) as keep:
        names = keep(_components(signed, rows, share, shingle), "near-components")
    named = signed.select("id", "n_shingles", "d0", "d1", "key").where("n_shingles > 0").join(names, ["d0", "d1"])
    wordless = signed.where("n_shingles = 0").select("id", "n_shingles", "key", F.col("id").alias("component_id"))
    return named.select("id", "n_shingles", "key", "component_id").unionByName(wordless)


def _components(signed: DataFrame, rows: DataFrame, share: int, shingle: int) -> DataFrame:
    """(d0, d1, component_id: the least id) of every class of equal sets."""
    # Of a class, the document of least id is the one whose text is read; its number is given when the table is written.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n_shingles", "at", "bands")).alias("x")
    classes = signed.where("n_shingles > 0").groupBy("d0", "d1").agg(first)
    classes = classes.select(F.monotonically_increasing_id().alias("rep"), "d0", "d1", F.col("x.id").alias("least"), "x.n_shingles", "x.at", "x.bands")
    classes = materialize(classes, "near-classes")

    banded = classes.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre <> last")
    buckets = materialize(buckets.drop("last"), "near-buckets")
    pairs = banded.join(buckets, "key").where("rep <> centre").select("centre", "rep").distinct()
    pairs = materialize(pairs, "near-pairs")

    wanted = pairs.select("rep").unionByName(pairs.select(F.col("centre").alias("rep"))).distinct()
    wanted = materialize(classes.join(wanted, "rep", "left_semi").select("rep", "d0", "d1", "at"), "near-wanted")
    # Texts that no pair needs are mostly held back by a filter of bounded size.  Rows of equal texts meet as one set per task before the shuffle.
    bitmaps = bitmaps_for(wanted.count())
    texts = may_hold(rows.select("body", "at"), materialize(make_filter(wanted, bitmaps, "at"), "near-filter"), bitmaps, "at")
    sets = texts.where("may_hold").select("body").mapInArrow(_as_sets(shingle), "d0 long, d1 long, shingles binary")
    sets = sets.groupBy("d0", "d1").agg(F.first("shingles").alias("shingles")).hint("merge").join(wanted.select("rep", "d0", "d1").hint("merge"), ["d0", "d1"])
    sets = materialize(sets.select("rep", "shingles"), "near-sets")

    left = sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("a"))
    right = sets.select("rep", F.col("shingles").alias("b"))
    both = pairs.hint("merge").join(right, "rep").hint("merge").join(left, "centre").select("centre", "rep", "a", "b")
    edges = materialize(both.mapInArrow(_verify(share), "a long, b long"), "near-edges")
    parts = connected_components(edges)

    def with_part(df: DataFrame, column: str, name: str) -> DataFrame:
        own = parts.select(F.col("node").alias(column), F.col("component").alias(name))
        return df.join(own, column, "left").withColumn(name, F.coalesce(name, column))

    # Whoever isn't in the component of a centre it met is compared with all others that met that centre.
    met = with_part(with_part(pairs, "rep", "component"), "centre", "centre_part")
    met = met.join(classes.select("rep", "n_shingles"), "rep").withColumn("loose", F.col("component") != F.col("centre_part"))
    met = materialize(met.drop("centre_part"), "near-met")

    def blocks(of) -> object:
        count, total = F.sum(F.when(of, 1).otherwise(0)), F.sum(F.when(of, F.col("n_shingles")).otherwise(0))
        return F.ceil(F.greatest(total / BLOCK_SHINGLES, count / BLOCK_ROWS)).cast("int")

    open_ = met.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), blocks(F.col("loose")).alias("loose_blocks"), blocks(F.lit(True)).alias("all_blocks"))
    open_ = materialize(open_.where("loose_blocks > 0 AND n > 1").drop("n"), "near-open")
    more = None
    if not open_.isEmpty():
        work = met.join(open_, "centre")
        place = F.xxhash64("rep", "centre")
        own = lambda count: F.pmod(place, F.col(count)).cast("int")
        others = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        loose = work.where("loose").select("centre", "rep", "component", own("loose_blocks").alias("i"), others("all_blocks").alias("j"), F.lit(0).alias("side"))
        every = work.select("centre", "rep", "component", others("loose_blocks").alias("i"), own("all_blocks").alias("j"), F.lit(1).alias("side"))
        work = materialize(loose.unionByName(every), "near-work").hint("merge").join(sets, "rep")
        more = materialize(work.groupBy("centre", "i", "j").applyInArrow(_compare_blocks(share), "a long, b long"), "near-more")

    # parts first, then the components that later links join.
    names = with_part(classes.select("rep", "d0", "d1", "least"), "rep", "part")
    if more is not None and not more.isEmpty():
        whole = connected_components(more)
        names = names.join(whole.select(F.col("node").alias("part"), F.col("component").alias("joined")), "part", "left").withColumn("part", F.coalesce("joined", "part"))
    names = materialize(names.select("d0", "d1", "least", "part"), "near-names")
    least = names.groupBy("part").agg(F.min("least").alias("component_id"))
    return names.join(materialize(least, "near-least"), "part").select("d0", "d1", "component_id")
