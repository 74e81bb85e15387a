"""Media columns: Netpbm and BMP bytes to arrays, area resizing by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import release, stash

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary greymap (P5) of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """An uncompressed 24-bit BMP of an array (height, width, 3) in RGB order."""
    h, w, _ = pixels.shape
    row = (w * 3 + 3) // 4 * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, w * 3)
    head = b"BM" + (54 + h * row).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = b"".join(x.to_bytes(n, "little") for x, n in ((40, 4), (w, 4), (h, 4), (1, 2), (24, 2), (0, 4), (h * row, 4), (2835, 4), (2835, 4), (0, 4), (0, 4)))
    return head + info + body.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, fields = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("the header ends early")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = (*fields, 1)[:3]
    depth = 3 if kind in (b"P3", b"P6") else 1
    if width <= 0 or height <= 0 or not 0 < top < 65536:
        raise ValueError("a size or maximum is out of range")
    n = width * height * depth
    if n > 8 * len(data):
        raise ValueError("samples are missing")
    if kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], dtype=np.int64)
    elif kind == b"P1":
        flat = 1 - (np.frombuffer(re.sub(rb"#[^\n\r]*|\s", b"", data[at:])[:n], np.uint8).astype(np.int64) - 48)
    elif kind == b"P4":
        line = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, line * height, at + 1).reshape(height, line), axis=1)
        flat = 1 - bits[:, :width].reshape(-1).astype(np.int64)
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
    if len(flat) < n:
        raise ValueError("samples are missing")
    if flat.size and (flat.max() > top or flat.min() < 0):
        raise ValueError("a sample is out of range")
    if top != 255:
        flat = (flat.astype(np.int64) * 255 + top // 2) // top
    image = flat.astype(np.uint8, copy=False).reshape(height, width, depth)
    return image[:, :, 0] if depth == 1 else image


def _bmp(data: bytes) -> np.ndarray:
    u = lambda at, n=4, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, head, width, height, bits, packed = u(10), u(14), u(18, 4, True), u(22, 4, True), u(28, 2), u(30)
    if len(data) < 54 or head < 40 or width <= 0 or not height or bits not in (1, 4, 8, 24, 32) or packed not in (0, 3):
        raise ValueError("a BMP of this kind is not supported")
    rows, line = abs(height), (width * bits + 31) // 32 * 4
    if rows * line > len(data):
        raise ValueError("samples are missing")
    body = np.frombuffer(data, np.uint8, rows * line, start).reshape(rows, line)
    if bits >= 24:
        step = bits // 8
        image = body[:, : width * step].reshape(rows, width, step)[:, :, 2::-1]
    else:
        colours = u(46) or 1 << bits
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(colours, 4)[:, 2::-1]
        if bits == 8:
            index = body[:, :width]
        else:
            cells = np.unpackbits(body, axis=1).reshape(rows, -1, bits)
            index = (cells @ (1 << np.arange(bits - 1, -1, -1)))[:, :width]
        if index.max() >= colours:
            raise ValueError("a sample is past the palette")
        image = palette[index]
    return np.ascontiguousarray(image[::-1] if height > 0 else image)


def decode(data: bytes) -> np.ndarray:
    """An array of 8-bit samples, (height, width) or (height, width, 3).  ValueError for anything else."""
    read = _netpbm if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2 else _bmp if data[:2] == b"BM" else None
    if read is None:
        raise ValueError("neither Netpbm nor BMP")
    try:
        return read(data)
    except (ValueError, OverflowError, IndexError, TypeError) as e:  # damaged headers lead to any of these
        raise ValueError(str(e)) from e


def grey(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the area under each target cell, fractions of samples included, by one integral image."""
    rows, cols = image.shape
    total = np.zeros((rows + 1, cols + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def along(table: np.ndarray, size: int, cells: int) -> np.ndarray:
        edge = np.arange(cells + 1) * (size / cells)
        low = np.minimum(edge.astype(int), size - 1)
        part = (edge - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    corner = along(along(total, rows, height).T, cols, width).T
    cells = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return cells / (rows / height * cols / width)


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Hexadecimal bits of whether each cell of a side x (side + 1) reduction is darker than its right neighbour."""
    small = np.round(area_resize(image, side, side + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def decode_media(media: DataFrame, id_col: str = "media_id", data_col: str = "data", side: int = 16) -> DataFrame:
    """Decode each media row: height, width, channels, NPY tile of side x side, difference hash, error.

    A null, empty or damaged value gives nulls and a message in ``error``; repeated rows are decoded each; an empty table gives
    no rows; other columns are not read.  Memory is bounded by one Arrow batch and its largest image.
    """
    schema = "media_id long, height int, width int, channels int, tile binary, dhash string, error string"
    fields = pa.schema([("media_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, data in zip(batch[0].to_pylist(), batch[1], strict=True):
                try:
                    image = decode(data.as_py() or b"")
                    luma = grey(image)
                    out.append((key, *image.shape[:2], image.ndim * 2 - 3 if image.ndim == 3 else 1, npy_tile(luma, side), difference_hash(luma), None))
                except ValueError as e:
                    out.append((key, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, fields.types, strict=True)], schema=fields)

    return media.select(F.col(id_col).cast("long"), F.col(data_col)).mapInArrow(run, schema)


WIDTH = 64
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary())])
_FEATURE_TYPES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def store(payload: bytes) -> bytes:
    """A bitmap WIDTH pixels wide if the payload fills whole rows of three samples a pixel, else a greymap WIDTH samples wide."""
    samples = np.frombuffer(payload, np.uint8)
    return encode_pgm(samples.reshape(-1, WIDTH)) if len(payload) % (3 * WIDTH) else encode_bmp(samples.reshape(-1, WIDTH, 3))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, media = [], []
        for text in batch[1].to_pylist():
            raw = (text or "").encode()
            sizes.append(len(raw))
            media.append(store(raw + bytes(-len(raw) % WIDTH if raw else WIDTH)))
        yield pa.RecordBatch.from_arrays([batch[0], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=_STORED)


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, size, stored in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2], strict=True):
            data = stored.as_py()
            image = decode(data)
            payload, luma = image.tobytes(), grey(image)
            out.append((key, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(luma), npy_tile(luma, 16)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 9, _FEATURES.types, strict=True)], schema=_FEATURES)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a bitmap or a greymap (doc_id, n_bytes, media); a null text is empty, an empty one is one row of zeros."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def op9_media(docs: DataFrame) -> DataFrame:
    """Media and NPY tiles are written to the shared folder and read back; the tile's digest is that of the written file's bytes."""
    stored = stash(text_media(docs), "media")
    tiles = stash(stored.mapInArrow(_inspect, _FEATURE_TYPES), "tiles")
    release(stored)
    return tiles.withColumn("tile_sha256", F.sha2("tile", 256)).drop("tile")
