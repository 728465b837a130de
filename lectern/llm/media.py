"""Media columns: Netpbm and BMP to numpy, resizing, NPY tiles, difference hashes.

An image is decoded to a numpy array, written as NPY tiles (whole, or resized by integral images) and
described by a difference hash.  Tiles stand one after another in one blob, row by row of the
image; those at its edges are as small as what is left, so reading them back loses and adds nothing.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffers

WIDTH = 64
BATCH_BYTES = 4 << 20
#: Rows and columns of a tile, at most.
TILE = 64
#: Samples of an image, at most (a header may promise any number).
MOST_SAMPLES = 1 << 31
UNREADABLE = (TypeError, ValueError, struct.error, IndexError, ZeroDivisionError, OverflowError, MemoryError)


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary grey map of 8-bit samples (P5)."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An uncompressed 24-bit (rows, columns, 3: RGB) or grey 8-bit (rows, columns) bitmap."""
    grey = samples.ndim == 2
    height, width = samples.shape[:2]
    stride = (width * (1 if grey else 3) + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * (1 if grey else 3)] = samples[::-1] if grey else samples[::-1, :, ::-1].reshape(height, -1)
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if grey else np.zeros((0, 4), np.uint8)
    if grey:
        palette[:, 3] = 0
    start = 54 + palette.size
    head = b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette.tobytes() + rows.tobytes()


_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def decode_netpbm(blob: bytes) -> np.ndarray:
    """P1 to P6: bit, grey and colour maps, plain and raw, 8 or 16 bits a sample."""
    kind, at, numbers = blob[:2], 2, []
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError(f"not Netpbm: {kind!r}")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(blob, at)
        if not m:
            raise ValueError("a Netpbm header ends early")
        if not m[1].isdigit() or len(m[1]) > 10:
            raise ValueError("a Netpbm header holds no number")
        numbers.append(int(m[1]))
        at = m.end()
    width, height, top = [*numbers, 1][:3]
    if not 0 < top < 65536 or width < 1 or height < 1 or width * height > min(8 * len(blob), MOST_SAMPLES):
        raise ValueError("a Netpbm header that its file can't hold")
    depth = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if depth == 3 else (height, width)
    count = height * width * depth
    if kind == b"P1":
        digits = re.sub(rb"#[^\n]*|\s", b"", blob[at:])[:count]
        flat = 1 - (np.frombuffer(digits, np.uint8) - 48)
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n]*", b"", blob[at:]).split()[:count], dtype=np.int64)
    elif kind == b"P4":
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(blob, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        flat = 1 - bits[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(blob, np.uint8 if top < 256 else ">u2", count, at + 1)
    if len(flat) != count:
        raise ValueError("a Netpbm raster ends early")
    return flat.astype(np.uint16 if top > 255 else np.uint8).reshape(shape)


def decode_bmp(blob: bytes) -> np.ndarray:
    """Uncompressed bitmaps of 8 (by palette), 24 or 32 bits: (rows, columns, 3) RGB, or grey where the palette is."""
    start, size, width, height, _, bits, packing = *struct.unpack_from("<I", blob, 10), *struct.unpack_from("<IiiHHI", blob, 14)
    if blob[:2] != b"BM" or packing != 0 or bits not in (8, 24, 32):
        raise ValueError("not a bitmap of a known kind")
    each = bits // 8
    if width < 1 or height == 0 or width * abs(height) * each > min(len(blob), MOST_SAMPLES):
        raise ValueError("a bitmap's header that its file can't hold")
    stride = (width * each + 3) // 4 * 4
    rows = np.frombuffer(blob, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * each]
    rows = rows[::-1] if height > 0 else rows
    if each > 1:
        return rows.reshape(abs(height), width, each)[:, :, 2::-1].copy()
    palette = np.frombuffer(blob, np.uint8, start - 14 - size, 14 + size).reshape(-1, 4)[:, 2::-1]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][rows]
    return palette[rows]


def decode(blob: bytes) -> np.ndarray:
    return decode_bmp(blob) if blob[:2] == b"BM" else decode_netpbm(blob)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area under each target cell, from an integral image; exact for fractional borders."""
    rows, columns = image.shape
    along = _prefix(image, np.linspace(0, rows, height + 1))
    both = _prefix(along.T, np.linspace(0, columns, width + 1)).T
    return both / (rows / height * columns / width)


def _prefix(image: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of rows between fractional cuts: the integral image, kept at the rows of the cuts alone."""
    low = np.minimum(cuts.astype(np.int64), image.shape[0] - 1)
    rows, place = np.unique(low, return_inverse=True)
    sums = np.add.reduceat(image, rows, axis=0, dtype=np.float64)
    integral = np.concatenate([np.zeros((1, image.shape[1])), np.cumsum(sums, axis=0)[:-1]])
    at = integral[place] + (cuts - low)[:, None] * image[low]
    return np.diff(at, axis=0)


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """Whether each cell of a (size, size + 1) thumbnail is darker than its right neighbour; hex."""
    small = np.round(area_resize(grey(image), size, size + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(tile: np.ndarray) -> bytes:
    """An NPY file of one tile."""
    key = (tile.shape, tile.dtype.str)
    if key not in _HEADS:
        file = io.BytesIO()
        np.lib.format.write_array_header_1_0(file, {"descr": tile.dtype.str, "fortran_order": False, "shape": tile.shape})
        _HEADS[key] = file.getvalue()
    return _HEADS[key] + tile.tobytes()


#: NPY headers by shape and type: at most TILE squared of them for each type.
_HEADS: dict[tuple, bytes] = {}
_SHAPES: dict[bytes, tuple[tuple[int, ...], np.dtype]] = {}


def npy_tiles(image: np.ndarray, tile: int = TILE) -> list[bytes]:
    """The image in tiles of at most (tile, tile), each an NPY file, row by row of tiles."""
    rows, columns = image.shape[:2]
    return [npy_tile(image[i : i + tile, j : j + tile]) for i in range(0, rows, tile) for j in range(0, columns, tile)]


def read_tiles(blob: bytes, columns: int) -> np.ndarray:
    """The image of ``columns`` columns whose tiles stand one after another in ``blob``."""
    at, bands, band, width = 0, [], [], 0
    while at < len(blob):
        start = at + 10 + int.from_bytes(blob[at + 8 : at + 10], "little")
        head = blob[at:start]
        if head not in _SHAPES:
            file = io.BytesIO(head)
            np.lib.format.read_magic(file)
            shape, _, kind = np.lib.format.read_array_header_1_0(file)
            _SHAPES[head] = shape, kind
        shape, kind = _SHAPES[head]
        count = int(np.prod(shape))
        band.append(np.frombuffer(blob, kind, count, start).reshape(shape))
        at, width = start + count * kind.itemsize, width + shape[1]
        if width >= columns:
            bands.append(band[0] if len(band) == 1 else np.concatenate(band, axis=1))
            band, width = [], 0
    return np.concatenate(bands)


def media_features(files: DataFrame, media_column: str = "media", thumbnail: int = 32, tile: int = 32) -> DataFrame:
    """Adds height, width, dhash and tiles (NPY files of the resized image) to rows with image files.

    Files that are null, empty or not decodable, whatever their headers promise, give null in all four.
    Repeated rows are independent; columns of the four names are replaced, others kept; an empty
    table gives an empty result.  A file is decoded whole: it takes its samples in memory, at most
    MOST_SAMPLES.
    """
    drop = ("height", "width", "dhash", "tiles")
    keep = files.drop(*drop)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in keep.dtypes), "height int, width int, dhash string, tiles array<binary>"])

    def run(batches):
        for batch in batches:
            found = []
            for blob in batch.column(media_column).to_pylist():
                try:
                    image = decode(blob)
                    small = np.round(area_resize(grey(image), thumbnail, thumbnail)).astype(np.uint8 if image.dtype == np.uint8 else np.uint16)
                    found.append((*image.shape[:2], difference_hash(image), npy_tiles(small, tile)))
                except UNREADABLE:
                    found.append((None,) * 4)
            columns = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.list_(pa.binary())))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *drop])

    return keep.mapInArrow(run, schema)


def text_images(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_media: bool = True) -> DataFrame:
    """Stores each text's bytes as NPY tiles of a grey map of 64 columns, reads them back and computes features.

    A text comes in as a binary grey map (P5) of its bytes, is decoded to an array and written as
    tiles of at most 64 x 64 samples; payload columns and feature are computed from the tiles alone.
    Result: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256 (of the tiles), feature (difference hash of the thumbnail), n_tiles and, if wanted,
    media (the tiles one after another).  Null text is empty; an empty text is 64 zero bytes; a very long
    one takes some copies of itself in memory, one text at a time.  Rows are independent, so repeated rows
    and clashing extra columns change nothing; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("body"))
    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_tiles int"
    schema += ", media binary" * with_media
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary())

    def stored(raw: np.ndarray) -> tuple:
        padded = np.zeros(max(-(-len(raw) // WIDTH), 1) * WIDTH, np.uint8)
        padded[: len(raw)] = raw
        tiles = npy_tiles(decode(encode_pgm(padded.reshape(-1, WIDTH))))
        media = b"".join(tiles)
        image = read_tiles(media, WIDTH)
        back = image.tobytes()
        found = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(image), len(tiles))
        return (*found, media) if with_media else found

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, BATCH_BYTES):
                found = [stored(data[offsets[k] : offsets[k + 1]]) for k in range(i, j)]
                columns = [pa.array([x[k] for x in found], t) for k, t in enumerate(kinds[: len(names) - 1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=names)

    return rows.mapInArrow(run, schema)
