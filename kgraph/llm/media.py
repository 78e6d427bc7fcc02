"""Media columns: Netpbm and BMP images to numpy arrays, NPY tiles, area-resized difference hashes.

Images are decoded by hand from their bytes, shrunk by the means of areas (integral images, exact for
any ratio), and kept as a stack of square tiles in NPY form in a binary column.

Defined results: a payload that is no image raises ValueError in ``decode`` and gives nulls in
``tiles``; a null payload gives nulls; in ``text_media`` a null or empty text is one tile of bytes 255,
equal rows give equal rows, rows without a doc_id are left out and an empty table gives no rows.
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

from .common import documents, stored
from .kernels import slabs

TILE = 24
_HEADER = re.compile(rb"P([1-6])((?:\s|#[^\n]*\n)+)(\d+)((?:\s|#[^\n]*\n)+)(\d+)")


def decode(data: bytes) -> np.ndarray:
    """Height x width (x 3) array of 8-bit samples from a Netpbm (P1 to P6) or BMP (1, 4, 8, 24 or 32 bit, not compressed) image."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    m = _HEADER.match(data)
    if not m:
        raise ValueError("neither a Netpbm nor a BMP image")
    kind, width, height, at = int(m[1]), int(m[3]), int(m[5]), m.end()
    most = 1
    if kind not in (1, 4):
        v = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)").match(data, at)
        if not v:
            raise ValueError("no greatest value")
        most, at = int(v[1]), v.end()
    depth = 3 if kind in (3, 6) else 1
    n = width * height * depth
    if kind <= 3:
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        values = np.array([int(x) for x in (re.findall(rb"[01]", body) if kind == 1 else body.split())[:n]], np.int64)
    elif kind == 4:
        row = -(-width // 8)
        bits = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        values = np.unpackbits(bits, axis=1)[:, :width].reshape(-1).astype(np.int64)
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at + 1).astype(np.int64) if len(data) - at - 1 >= n * (1 + (most > 255)) else np.zeros(0, np.int64)
    if len(values) != n or most < 1:
        raise ValueError("the image is cut short")
    values = (1 - values) * 255 if kind in (1, 4) else values if most == 255 else (values * 255 + most // 2) // most
    return values.astype(np.uint8).reshape((height, width, 3) if depth == 3 else (height, width))


def _decode_bmp(data: bytes) -> np.ndarray:
    try:
        (begin,), (head,) = struct.unpack_from("<I", data, 10), struct.unpack_from("<I", data, 14)
        width, height, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    except struct.error as e:
        raise ValueError("the image is cut short") from e
    if bits not in (1, 4, 8, 24, 32) or packed not in (0, 3) or (packed == 3 and bits != 32) or width <= 0:
        raise ValueError("a kind of BMP that isn't read")
    row = (width * bits + 31) // 32 * 4
    if len(data) < begin + row * abs(height):
        raise ValueError("the image is cut short")
    rows = np.frombuffer(data, np.uint8, row * abs(height), begin).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if bits >= 24:
        return np.ascontiguousarray(rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1])
    places = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)[:, :width] @ (1 << np.arange(bits)[::-1])
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    table = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    return np.ascontiguousarray(table[np.minimum(places, used - 1)])


def encode_pgm(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.tobytes()


def grey(a: np.ndarray) -> np.ndarray:
    """One sample a pixel, by the integer weights 299, 587 and 114 in 1000."""
    return a if a.ndim == 2 else ((a.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000).astype(np.uint8)


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the area that each new pixel covers, fractions of old ones included, by an integral image."""
    total = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    total[1:, 1:] = a.astype(np.float64).cumsum(0).cumsum(1)

    def at(edges: np.ndarray, whole: np.ndarray, axis: int) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), whole.shape[axis] - 2)
        part = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return np.take(whole, low, axis) * (1 - part) + np.take(whole, low + 1, axis) * part

    y, x = np.arange(height + 1) * a.shape[0] / height, np.arange(width + 1) * a.shape[1] / width
    sums = at(x, at(y, total, 0), 1)
    return np.diff(np.diff(sums, axis=0), axis=1) / ((a.shape[0] / height) * (a.shape[1] / width))


def difference_hash(a: np.ndarray, size: int = 8) -> str:
    """Hex digits of size x size bits: whether each cell of the shrunk image is darker than the next."""
    small = np.round(area_resize(grey(a), size, size + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_tiles(a: np.ndarray, tile: int = TILE) -> bytes:
    """NPY bytes of the tiles, row by row; edges are filled with 255."""
    a = a if a.ndim == 3 else a[:, :, None]
    h, w = -(-a.shape[0] // tile), -(-a.shape[1] // tile)
    whole = np.full((h * tile, w * tile, a.shape[2]), 255, np.uint8)
    whole[: a.shape[0], : a.shape[1]] = a
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(whole.reshape(h, tile, w, tile, -1).transpose(0, 2, 1, 3, 4).reshape(h * w, tile, tile, -1).squeeze(-1) if a.shape[2] == 1 else whole.reshape(h, tile, w, tile, -1).transpose(0, 2, 1, 3, 4).reshape(h * w, tile, tile, -1)))
    return out.getvalue()


def from_tiles(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def tiles(df: DataFrame, column: str, size: int = TILE) -> DataFrame:
    """Adds height, width, channels, npy (tiles) and dhash to a table of images in a binary column."""
    names = ["height", "width", "channels", "npy", "dhash"]
    kept = [c for c in df.columns if c not in names]

    def work(batches):
        for b in batches:
            out = []
            for x in b.column(column).to_pylist():
                try:
                    a = decode(x) if x is not None else None
                except ValueError:
                    a = None
                out.append((a.shape[0], a.shape[1], a.shape[2] if a.ndim == 3 else 1, to_tiles(a, size), difference_hash(a)) if a is not None and a.size else (None,) * 5)
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*kept, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema)
    return df.select(*kept).mapInArrow(work, f"{fields}, height int, width int, channels int, npy binary, dhash string")


def text_media(docs: DataFrame) -> DataFrame:
    """Each text's UTF-8 bytes, filled with 255 to a multiple of 576, as a grey image 24 wide, kept as
    NPY tiles in a Parquet table, read back from it, with digests and the difference hash."""
    unit = TILE * TILE
    form = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("npy", pa.binary())])

    def store(batches):
        for b in batches:
            for s in slabs(b.column("doc_id").to_numpy(), b.column("text")):
                out = []
                for i, doc_id in enumerate(s.ids.tolist()):
                    text = s.text(i)
                    payload = text + b"\xff" * (max(unit, -(-len(text) // unit) * unit) - len(text))
                    image = decode(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, TILE)))
                    out.append((doc_id, len(text), to_tiles(image)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), form, strict=True)], schema=form)

    names = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def read(batches):
        for b in batches:
            out = []
            for doc_id, n, npy in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "npy")), strict=True):
                a = from_tiles(npy)
                payload = a.tobytes()
                out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(npy), hashlib.sha256(npy).hexdigest(), difference_hash(a.reshape(-1, TILE))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), names, strict=True)], schema=names)

    media = stored(documents(docs).mapInArrow(store, "doc_id long, n_bytes long, npy binary"), "media")
    return media.select(F.col("doc_id"), "n_bytes", "npy").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
