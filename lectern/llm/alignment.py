"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of aligned pairs.

Both tokenizers encode a text with a space before it, and each token stands for its bytes, so a running sum of
sizes gives token ends as byte offsets.  Ends common to both (``intersect1d``) cut the tokens into groups; ``searchsorted`` labels
tokens by group, and links (all pairs of a token of one side and one of the other in a group) are expanded by repeating
indexes.  Groups of many links are expanded from their distinct tokens and how often those occur.

A task packs about BATCH_BYTES of text into one row: the distinct pairs of the batch with the number of its
documents that hold each, and for each document the places of its pairs among those.  Pairs alone are shuffled, once a batch: a first
stage sums them by pair and salt, a second one by pair.  The counts go back to the batches, which sum them up for each document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BpeModel, Encoder, Pieces
from .common import materialize, scratch, slices, text_buffers

#: Bytes of text that are encoded at once, and in one batch of pairs.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
#: Links of a group from which its distinct tokens are taken first.
WIDE = 256
#: Parts that the occurrences of one pair are dealt to before they meet.
SALTS = 32
_MARK = "▁"


class PieceModel:
    """A sentence-piece BPE vocabulary with byte fallback; bounded by its file, and sent to tasks as that file's bytes.

    No piece has a mark of a space after another character, so runs of spaces with what follows them are encoded one by one.
    """

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.proto = file.read()
        self.special: dict[bytes, int] = {}
        self._open()

    def _open(self) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=self.proto)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any(_MARK in x.lstrip(_MARK) for x in names):
            raise ValueError("the vocabulary has pieces that go on after a space")
        self.table = [bytes([int(x[3:5], 16)]) if self.library.is_byte(i) else x.replace(_MARK, " ").encode() for i, x in enumerate(names)]
        self.space = self.library.piece_to_id(_MARK)

    def __getstate__(self):
        return {"proto": self.proto, "special": {}}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._open()

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of data[start:end], flat, and the number of each one's; each begins with a space, which the library adds by itself."""
        raw = data.tobytes()
        found = self.library.encode([raw[a + 1 : b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)], num_threads=1)
        found = [x or [self.space] for x in found]
        counts = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.int64, int(counts.sum())), counts


class PieceEncoder(Encoder):
    """Encodes texts that begin with a space (or are empty), by runs of spaces and what follows each."""

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = data == 0x20
        head = space.copy()
        head[1:] &= ~space[:-1]
        head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        at = np.flatnonzero(head)
        number = self._known(data, at, np.r_[at[1:], len(data)]) if len(at) else np.zeros(0, np.int64)
        return number, np.searchsorted(at, offsets)


def with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each text that isn't empty."""
    some = offsets[1:] > offsets[:-1]
    return np.insert(data, offsets[:-1][some], 0x20), offsets + np.r_[0, np.cumsum(some)]


def faithful(pieces: Pieces, ids: np.ndarray, cuts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: whether the bytes of its tokens are its own."""
    ends = np.r_[0, np.cumsum(pieces.sizes[ids])]
    same = np.diff(ends[cuts]) == np.diff(offsets)
    if len(same):
        joined = np.frombuffer(pieces.join(ids[np.repeat(same, np.diff(cuts))], np.zeros(1, np.int64))[0], np.uint8)
        own = data if same.all() else data[np.repeat(same, np.diff(offsets))]
        rows = np.flatnonzero(same)
        at = np.cumsum(np.diff(offsets)[rows])
        same[rows[np.unique(np.searchsorted(at, np.flatnonzero(joined != own), "right"))]] = False
    return same


class Aligned:
    """Groups and links of some texts; tokens of each side are flat, ``cuts`` tell where texts' tokens begin."""

    def __init__(self, a: np.ndarray, a_cuts: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_cuts: np.ndarray, b_sizes: np.ndarray):
        self.a, self.b, self.a_cuts, self.b_cuts = a, b, a_cuts, b_cuts
        a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
        ends = np.intersect1d(a_ends, b_ends, assume_unique=True)
        self.a_group, self.b_group = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        self.in_a, self.in_b = (np.bincount(g, minlength=len(ends)) for g in (self.a_group, self.b_group))
        self.a_first, self.b_first = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        #: The text of each group.
        self.text = np.searchsorted(a_cuts, self.a_first, "right") - 1

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, a << 32 | b, how often) of all links; a pair of a text may stand in several rows."""
        wide = self.in_a * self.in_b > WIDE
        at = np.flatnonzero(~wide[self.a_group])
        times = self.in_b[self.a_group[at]]
        heads = np.cumsum(times) - times
        other = np.repeat(self.b_first[self.a_group[at]] - heads, times) + np.arange(int(times.sum()))
        texts, pairs, weights = [np.repeat(self.text[self.a_group[at]], times)], [np.repeat(self.a[at].astype(np.int64) << 32, times) | self.b[other]], [np.ones(len(other), np.int64)]
        for g in np.flatnonzero(wide).tolist():
            x, n = np.unique(self.a[self.a_first[g] :][: self.in_a[g]], return_counts=True)
            y, m = np.unique(self.b[self.b_first[g] :][: self.in_b[g]], return_counts=True)
            pairs.append((x.astype(np.int64)[:, None] << 32 | y).reshape(-1))
            weights.append((n[:, None] * m).reshape(-1))
            texts.append(np.full(len(pairs[-1]), self.text[g]))
        return np.concatenate(texts), np.concatenate(pairs), np.concatenate(weights)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, how often), sorted, each pair once a text."""
        text, pair, weight = self.links()
        if not len(text):
            return text, pair, weight
        pairs, place = np.unique(pair, return_inverse=True)
        keys, at = np.unique(text * len(pairs) + place, return_inverse=True)
        return keys // len(pairs), pairs[keys % len(pairs)], np.bincount(at, weights=weight).astype(np.int64)

    def shown(self, numerals: Pieces, a_size: int, b_size: int) -> list[str]:
        """SHA-256 of each text's groups, ``a1,a2|b1;a3|b2,b3``; nothing for texts without tokens."""
        more_a, more_b = (np.r_[g[1:] == g[:-1], False][: len(g)] for g in (self.a_group, self.b_group))
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + self.b_first[self.a_group]] = self.a + np.where(more_a, 0, a_size)
        order[np.arange(len(self.b)) + (self.a_first + self.in_a)[self.b_group]] = 2 * a_size + self.b + np.where(more_b, 0, b_size)
        raw, at = numerals.join(order, self.a_cuts + self.b_cuts)
        return [hashlib.sha256(raw[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(at[:-1], at[1:], strict=True)]


def planes(values: np.ndarray) -> bytes:
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unplanes(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pa.decompress(raw, 4 * n, codec="zstd", asbytes=True) if n else b"", np.uint8).reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


_BATCH = "batch long, ids array<long>, figures array<long>, shas array<string>, pairs array<long>, documents array<int>, held array<int>, places binary, times binary"


def _kept(cuts: np.ndarray, ids: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(cuts)
    return ids[np.repeat(keep, sizes)], np.r_[0, np.cumsum(sizes * keep)]


def _batches(shared):
    """Rows _BATCH: figures are n_a, n_b, n_groups and n_links of each text in turn."""

    def run(batches):
        a_model, b_model = shared.value
        a_encoder, b_encoder = Encoder(a_model, special=False), PieceEncoder(b_model)
        a_pieces, b_pieces = Pieces(a_model.table), Pieces(b_model.table)
        a_size, b_size = len(a_model.table), len(b_model.table)
        numerals = Pieces([b"%d%s" % (i, end) for size, ends in ((a_size, b",|"), (b_size, b",;")) for end in (ends[:1], ends[1:]) for i in range(size)])
        place = TaskContext.get().partitionId() << 32
        ids, figures, shas, parts, size = [], [], [], [], 0

        def row():
            pairs, own = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
            held = np.concatenate([p[0] for p in parts])
            # Places ascend within a text, so differences are small.
            head = np.r_[0, np.cumsum(held)[:-1]][held > 0]
            step = np.diff(own, prepend=0)
            step[head] = own[head]
            values = [place, pa.concat_arrays(ids), np.concatenate(figures).reshape(-1), sum(shas, []), pairs, np.bincount(own, minlength=len(pairs)), held, planes(step), planes(np.concatenate([p[2] for p in parts]))]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _BATCH.split(", ")])

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, SLICE_BYTES):
                text, cuts = with_space(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                a, a_cuts = a_encoder.encode(text, cuts)
                b, b_cuts = b_encoder.encode(text, cuts)
                good = faithful(a_pieces, a, a_cuts, text, cuts) & faithful(b_pieces, b, b_cuts, text, cuts)
                (a, a_cuts), (b, b_cuts) = _kept(a_cuts, a, good), _kept(b_cuts, b, good)
                found = Aligned(a, a_cuts, a_pieces.sizes, b, b_cuts, b_pieces.sizes)
                owner, pairs, times = found.distinct()
                if size and size + offsets[j] - offsets[i] > BATCH_BYTES:
                    yield row()
                    place, ids, figures, shas, parts, size = place + 1, [], [], [], [], 0
                n = j - i
                ids.append(batch.column(0).slice(i, n))
                links = np.bincount(found.text, weights=found.in_a * found.in_b, minlength=n).astype(np.int64)
                figures.append(np.stack([np.diff(a_cuts), np.diff(b_cuts), np.bincount(found.text, minlength=n), links], axis=1))
                shas.append(found.shown(numerals, a_size, b_size))
                parts.append((np.bincount(owner, minlength=n), pairs, times))
                size += int(offsets[j] - offsets[i])
        if ids:
            yield row()

    return run


_ROW = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(key, batch: pa.Table, told: pa.Table) -> pa.Table:
    """A batch's rows, from its pairs' counts."""
    one = {name: batch[name][0] for name in batch.column_names}
    ids = pa.array(one["ids"].values, pa.int64())
    figures = np.asarray(one["figures"].values).reshape(-1, 4)
    held = np.asarray(one["held"].values).astype(np.int64)
    documents, best = np.zeros((2, len(one["pairs"].values)), np.int64)
    documents[told["place"].to_numpy()] = told["documents"].to_numpy()
    best[told["place"].to_numpy()] = told["best"].to_numpy(zero_copy_only=False)
    n = int(held.sum())
    step, times = unplanes(one["places"].as_py(), n), unplanes(one["times"].as_py(), n)
    owner = np.repeat(np.arange(len(held)), held)
    total = np.cumsum(step)
    head = np.cumsum(held) - held
    before = np.r_[0, total][head]
    at = total - before[owner]
    sums = np.zeros((2, len(held)), np.int64)
    np.add.at(sums[0], owner, times * best[at])
    np.add.at(sums[1], owner, times * documents[at])
    columns = [ids, *figures.T, *sums, one["shas"].values]
    return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in _ROW.split(", ")])


def align_tokenizers(docs: DataFrame, a: BpeModel, b: PieceModel, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row per input row, and all pairs with the number of documents that hold them linked.

    Rows: id, n_a, n_b (tokens), n_groups, n_links (token occurrences of both sides that share a group), n_best (links whose pair is
    in as many documents as any pair of its a token), count_sum (documents of the pair, over all links), groups_sha256 (of
    ``a1,a2|b1;a3|b2,b3``).  Pairs: a, b, documents, best.

    Special tokens in a text are plain text.  Null and empty texts, and those whose tokens' bytes of either side aren't a space
    and the text (as where the text has U+2581), have no tokens: zeros and an empty string.  A very long text is encoded by itself, with some hundred
    bytes of memory a byte.  Every row is a document: repeated rows count again, null ids stay null.  Other columns are ignored, whatever
    their names; an empty table gives empty results.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((a, b))  # bounded by the vocabulary files
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("body"))
    with scratch(spark) as keep:
        aligned = materialize(rows.mapInArrow(_batches(shared), _BATCH), "align-batches")
        named = aligned.select("batch", F.posexplode(F.arrays_zip("pairs", "documents")).alias("place", "x")).select("batch", "place", F.col("x.pairs").alias("pair"), F.col("x.documents").alias("n"))
        salted = named.groupBy("pair", F.pmod(F.xxhash64("batch"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
        counts = materialize(salted.groupBy("pair").agg(F.sum("n").alias("documents")), "align-counts")
        token = F.shiftright("pair", 32)
        most = counts.groupBy(token.alias("a")).agg(F.max("documents").alias("most"))
        counts = counts.withColumn("a", token).join(F.broadcast(most), "a")  # a row for each token of the vocabulary at most
        counts = keep(counts.select("a", (F.col("pair").bitwiseAND(2**32 - 1)).alias("b"), "documents", (F.col("documents") == F.col("most")).alias("best"), "pair"), "align-pairs")
        told = named.select("batch", "place", "pair").hint("merge").join(counts.select("pair", "documents", "best").hint("merge"), "pair").select(F.col("batch").alias("owner"), "place", "documents", "best")
        out = keep(aligned.groupBy("batch").cogroup(told.groupBy("owner")).applyInArrow(_summed, _ROW), "align-rows")
    return out, counts.drop("pair")
