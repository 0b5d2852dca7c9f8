"""Media columns: Netpbm and BMP images as numpy arrays, resized tiles and difference hashes.

Images are decoded to arrays, area-resized by integral images (sums over any
rectangle from four corners), written as NPY tiles, and summed up by a
difference hash, all in one pass over Arrow batches without a shuffle.

Edge cases: a null or empty payload is an image of one row of zeros; a damaged
or unknown image gives null results, never an error; equal payloads give equal
results; extra columns are ignored.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
STRIP = 4096  # rows of one strip of an integral image; bounds memory for tall images
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def encode_pgm(image: np.ndarray) -> bytes:
    """A grey image of uint8 as binary PGM (P5)."""
    h, w = image.shape
    return b"P5\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_ppm(image: np.ndarray) -> bytes:
    """An RGB image of uint8 as binary PPM (P6)."""
    h, w, _ = image.shape
    return b"P6\n%d %d\n255\n" % (w, h) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """A grey (8 bits with a palette) or RGB (24 bits) image of uint8 as uncompressed BMP."""
    h, w = image.shape[:2]
    bits = 8 if image.ndim == 2 else 24
    rows = image if bits == 8 else image[:, :, ::-1].reshape(h, 3 * w)
    stride = (rows.shape[1] + 3) // 4 * 4
    body = np.zeros((h, stride), np.uint8)
    body[:, : rows.shape[1]] = rows[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if bits == 8 else b""
    start = 54 + len(palette)
    head = struct.pack("<2sIHHI", b"BM", start + body.nbytes, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, body.nbytes, 2835, 2835, 256 if bits == 8 else 0, 0) + palette + body.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, head = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        if m is None:
            raise ValueError("bad Netpbm header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    top = head[2] if len(head) > 2 else 1
    n = 3 if kind in (3, 6) else 1
    if kind in (1, 2, 3):
        words = re.sub(rb"#[^\n]*", b"", data[at:])
        flat = np.array(list(re.sub(rb"\s", b"", words)), np.uint8) - 48 if kind == 1 else np.array(words.split(), np.uint32)
        flat = flat[: w * h * n]
    elif kind == 4:
        stride = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * h, at + 1).reshape(h, stride), axis=1)
        flat = bits[:, :w].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * n, at + 1)
    if kind in (1, 4):
        flat = (1 - flat) * 255  # in bitmaps 1 is black
    elif top != 255:
        flat = (flat.astype(np.uint32) * 255 + top // 2) // top
    image = flat.astype(np.uint8, copy=False)
    return image.reshape((h, w, 3) if n == 3 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    start = struct.unpack_from("<I", data, 10)[0]
    size, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    used = struct.unpack_from("<I", data, 46)[0]
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("unsupported BMP")
    tall, n = abs(h), bits // 8
    stride = (w * n + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * tall, start).reshape(tall, stride)[:, : w * n]
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, 4 * (used or 256), 14 + size).reshape(-1, 4)
        grey = bool((colours[:, 0] == colours[:, 1]).all() and (colours[:, 1] == colours[:, 2]).all())
        return colours[:, 0][rows] if grey else colours[:, 2::-1][rows]
    return rows.reshape(tall, w, n)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """Netpbm (P1 to P6) or uncompressed BMP to uint8 arrays (h, w) or (h, w, 3)."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("not a Netpbm or BMP image")


def _edges(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(m + 1) * (n / m)
    low = np.minimum(at.astype(np.int64), n)
    return low, at - low


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the rectangle of each target pixel, from an integral image made strip by strip.

    Rectangles need not end on pixel edges: the integral image is read with
    linear interpolation, which is exact for areas.
    """
    h, w = image.shape
    ys, fy = _edges(h, height)
    xs, fx = _edges(w, width)
    corner = np.zeros((height + 1, width + 1))
    above = np.zeros(w + 1)
    for top in range(0, h, STRIP):
        strip = image[top : top + STRIP]
        sums = np.zeros((len(strip) + 1, w + 1))
        np.cumsum(strip, axis=0, dtype=np.float64, out=sums[1:, 1:])
        np.cumsum(sums[1:, 1:], axis=1, out=sums[1:, 1:])
        sums += above
        above = sums[-1]
        mine = np.flatnonzero((ys >= top) & (ys < top + len(strip)) | ((top + len(strip) == h) & (ys == h)))
        if len(mine):
            rows = ys[mine] - top
            below = np.minimum(rows + 1, len(strip))
            line = sums[rows] * (1 - fy[mine])[:, None] + sums[below] * fy[mine][:, None]
            right = np.minimum(xs + 1, w)
            corner[mine] = line[:, xs] * (1 - fx) + line[:, right] * fx
    area = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return area * ((height / h) * (width / w))


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of an RGB image in integers; grey images stay."""
    if image.ndim == 2:
        return image
    c = image.astype(np.uint32)
    return ((299 * c[:, :, 0] + 587 * c[:, :, 1] + 114 * c[:, :, 2] + 500) // 1000).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as 16 hex digits: whether each of 8 x 9 area means is under its right neighbour's."""
    small = np.floor(area_resize(grey(image), 8, 9) * 16 + 0.5)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int) -> bytes:
    """The image area-resized to side x side, rounded to uint8, as an NPY file."""
    to = io.BytesIO()
    np.save(to, np.clip(np.floor(area_resize(grey(image), side, side) + 0.5), 0, 255).astype(np.uint8), allow_pickle=False)
    return to.getvalue()


def payload_image(payload: bytes) -> np.ndarray:
    """The payload with zeros up to a positive multiple of 64, as rows of 64 samples."""
    n = max(1, -(-len(payload) // WIDTH)) * WIDTH
    flat = np.zeros(n, np.uint8)
    flat[: len(payload)] = np.frombuffer(payload, np.uint8)
    return flat.reshape(-1, WIDTH)


def media_features(df: DataFrame, id_col: str, media_col: str, tile: int = 32, keep: bool = False) -> DataFrame:
    """Decode each stored image: samples, NPY tile and difference hash; the stored bytes too if ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, media = batch.column(0), batch.column(1)
            samples, tiles, hashes = [], [], []
            for m in media:
                try:
                    image = decode(m.as_py())
                    samples.append(image.tobytes())
                    tiles.append(npy_tile(image, tile))
                    hashes.append(difference_hash(image))
                except (ValueError, TypeError, struct.error):
                    samples.append(None)
                    tiles.append(None)
                    hashes.append(None)
            out = [ids, pa.array(samples, pa.binary()), pa.array(tiles, pa.binary()), pa.array(hashes, pa.string())]
            yield pa.RecordBatch.from_arrays(out + ([media] if keep else []), ["id", "samples", "tile_npy", "dhash", *(["media"] if keep else [])])

    src = df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, samples binary, tile_npy binary, dhash string" + (", media binary" if keep else ""))


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fmt: str = "pgm", tile: int = 32, with_media: bool = True) -> DataFrame:
    """Each text's bytes stored as an image, read back from the stored form, with tile and hash.

    Columns: doc_id, n_bytes, payload (as read back), media (the stored form),
    tile_npy, feature. Without ``with_media`` the stored form is summed up by
    its length and SHA-256 only, which saves moving it out of Python.
    """
    import hashlib

    store = {"pgm": encode_pgm, "bmp": encode_bmp}[fmt]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                raw = text.as_buffer() if text.is_valid else None
                raw = raw.to_pybytes() if raw is not None else b""
                media = store(payload_image(raw))
                back = decode(media)
                row = (len(raw), back.tobytes(), len(media), hashlib.sha256(media).hexdigest(), npy_tile(back, tile), difference_hash(back), media if with_media else None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload", "media_bytes", "media_sha256", "tile_npy", "feature", "media"])

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("b"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, tile_npy binary, feature string, media binary")
