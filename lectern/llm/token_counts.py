"""Token counts by a separator scan over flat, unindexed token files.

A token file is a run of documents, each ended by an end-of-document identifier;
nothing says where they begin.  Files are read in blocks of a fixed number of tokens.
Each block is searched for the identifier on its own, vectorised; a prefix scan over the blocks'
summaries (tokens, separators, place of the last separator) then stitches
documents that cross blocks.  The scan has two levels, segments of blocks and blocks of a
segment, so no task sees all blocks of a file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BATCH_BYTES, BpeModel, Encoder
from .common import materialize, slices, text_buffers

#: Tokens in a block, and blocks in a segment of the prefix scan.
BLOCK_TOKENS = 1 << 16
SEGMENT_BLOCKS = 1024
WIDTHS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


def pack_streams(docs: DataFrame, model: BpeModel, separator: int, id_column: str = "doc_id", text_column: str = "text", width: int = 2, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Encodes texts into flat token files: (file, block, payload), and who stands where: (file, place, id).

    Each task writes one file; texts that hold the separator's string encode it as ordinary
    text.  Null and empty texts are documents of no tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary file
    kind = WIDTHS[width]
    if max(len(model.table) - 1, separator) >= 1 << 8 * width:
        raise ValueError(f"ids of this vocabulary don't fit into {width} bytes")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("body"))
    names = ["file", "place", "id", "payload"]

    def run(batches):
        file = TaskContext.get().partitionId()
        encoder = Encoder(shared.value, special=False)
        place, block, pending, size = 0, 0, [], 0

        def rows_of(places, ids, payloads):
            n = len(places)
            return pa.RecordBatch.from_arrays([pa.array([file] * n, pa.int64()), pa.array(places, pa.int64()), ids, pa.array(payloads, pa.binary())], names=names)

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, BATCH_BYTES):
                ids, cuts = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                pending.append(np.insert(ids, cuts[1:], separator).astype(kind))
                size += len(pending[-1])
                yield rows_of(range(place, place + j - i), batch.column(0).slice(i, j - i), [None] * (j - i))
                place += j - i
                if size >= block_tokens:
                    flat = np.concatenate(pending)
                    full = len(flat) // block_tokens
                    for k in range(full):
                        yield rows_of([block + k], pa.nulls(1, pa.int64()), [flat[k * block_tokens : (k + 1) * block_tokens].tobytes()])
                    block += full
                    pending = [flat[full * block_tokens :]]
                    size = len(pending[0])
        if size:
            yield rows_of([block], pa.nulls(1, pa.int64()), [np.concatenate(pending).tobytes()])

    both = materialize(rows.mapInArrow(run, "file long, place long, id long, payload binary"), "token-streams")
    blocks = both.where(F.col("payload").isNotNull()).select("file", F.col("place").alias("block"), "payload")
    return blocks, both.where(F.col("payload").isNull()).select("file", "place", "id")


def _open_file(path: str):
    """A seekable file by its URI, on any file system that Arrow knows."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS, open_file=_open_file) -> DataFrame:
    """(file, block, payload) of binary files of little-endian token identifiers, of any length.

    Spark lists names and lengths alone; each block is read by its offset in the task that gets it, so a file is dealt out like
    others and no task holds more than a block of it.  ``open_file`` opens a URI on the executors.  An
    empty file has one empty block; bytes after the last whole identifier are an error.
    """
    size = width * block_tokens
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    whole = F.assert_true(F.col("length") % width == 0, F.concat(F.lit("no whole number of tokens: "), F.col("file")))
    last = F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0)).cast("long")
    blocks = files.where(whole.isNull()).select("file", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))

    def read(batches):
        for batch in batches:
            files, numbers = (batch.column(k).to_pylist() for k in (0, 1))
            handle, opened = None, None
            for k, (file, number) in enumerate(zip(files, numbers, strict=True)):
                if opened != file:
                    if handle is not None:
                        handle.close()
                    handle, opened = open_file(file), file
                handle.seek(number * size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([handle.read(size)], pa.binary())], names=["file", "block", "payload"])
            if handle is not None:
                handle.close()

    return blocks.repartition("file", "block").mapInArrow(read, "file string, block long, payload binary")


def separator_scan(blocks: DataFrame, separator: int, width: int = 2) -> DataFrame:
    """(file, place, start, n_tokens) of every document; input has file, block and payload.

    ``place`` counts documents of a file from 0, ``start`` tokens of it.  Two
    separators in a row hold an empty document between them; tokens after the last
    separator are one more document.  Blocks need not be equally long; null and empty
    ones hold nothing.  An empty table gives an empty result.
    """
    kind = WIDTHS[width]

    def run(batches):
        for batch in batches:
            sizes, found = [], []
            for payload in batch.column(2).to_pylist():
                tokens = np.frombuffer(payload or b"", kind)
                sizes.append(len(tokens))
                found.append(np.flatnonzero(tokens == separator).astype(np.int32))
            marks = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), marks], names=["file", "block", "size", "marks"])

    file = dict(blocks.dtypes)["file"]
    scanned = blocks.select("file", F.col("block").cast("long").alias("block"), "payload")
    scanned = materialize(scanned.mapInArrow(run, f"file {file}, block long, size long, marks array<int>"), "token-marks")
    one = scanned.select("file", "block", F.floor(F.col("block") / SEGMENT_BLOCKS).alias("segment"), "size", F.size("marks").alias("n"), F.when(F.size("marks") > 0, F.element_at("marks", -1)).alias("last"))

    def scan(df: DataFrame, keys: list[str], order: str) -> DataFrame:
        """Tokens, separators and the last separator's place before each row, within ``keys``."""
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("tokens_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        df = df.withColumn("marks_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        return df.withColumn("last_before", F.max(F.col("tokens_before") + F.col("last")).over(before))

    inner = materialize(scan(one, ["file", "segment"], "block"), "token-blocks")
    whole = inner.groupBy("file", "segment").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.max(F.col("tokens_before") + F.col("last")).alias("last"))
    whole = materialize(whole, "token-segments")
    outer = scan(whole, ["file"], "segment").select("file", "segment", *[F.col(c).alias(f"outer_{c}") for c in ("tokens_before", "marks_before", "last_before")])
    placed = inner.join(outer, ["file", "segment"]).select(
        "file",
        "block",
        (F.col("outer_tokens_before") + F.col("tokens_before")).alias("tokens"),
        (F.col("outer_marks_before") + F.col("marks_before")).alias("marks_before"),
        F.coalesce(F.col("outer_tokens_before") + F.col("last_before"), F.col("outer_last_before"), F.lit(-1)).alias("previous"),
    )
    ends = scanned.join(materialize(placed, "token-placed"), ["file", "block"])
    ends = ends.select("file", "marks_before", "tokens", "previous", "marks", F.posexplode("marks").alias("k", "mark"))
    start = F.when(F.col("k") == 0, F.col("previous") + 1).otherwise(F.col("tokens") + F.element_at("marks", F.greatest(F.col("k"), F.lit(1))) + 1)
    ended = ends.select("file", (F.col("marks_before") + F.col("k")).cast("long").alias("place"), start.cast("long").alias("start"), (F.col("tokens") + F.col("mark")).alias("end"))
    ended = ended.select("file", "place", "start", (F.col("end") - F.col("start")).cast("long").alias("n_tokens"))

    files = whole.join(outer.select("file", "segment", "outer_tokens_before"), ["file", "segment"])
    files = files.groupBy("file").agg(F.sum("size").alias("size"), F.sum("n").alias("place"), F.max(F.col("outer_tokens_before") + F.col("last")).alias("last"))
    start = F.coalesce(F.col("last") + 1, F.lit(0))
    rest = files.select("file", F.col("place").cast("long").alias("place"), start.cast("long").alias("start"), (F.col("size") - start).cast("long").alias("n_tokens")).where("n_tokens > 0")
    return ended.unionByName(rest)


def document_token_counts(docs: DataFrame, model: BpeModel, separator: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens) of every row: its text packed into token files, counted by the scan.

    Null and empty texts have no tokens; repeated rows, null ids and extra columns
    change nothing; a very long text crosses as many blocks as it needs; an empty table gives an empty
    result.  Most of the work is encoding the texts.
    """
    blocks, places = pack_streams(docs, model, separator, id_column, text_column)
    counts = separator_scan(blocks, separator)
    return places.join(counts, ["file", "place"], "left").select("id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
