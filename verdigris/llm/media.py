"""Media columns: Netpbm and BMP images to numpy arrays, area-resized, with NPY tiles and difference hashes.

`decode` reads Netpbm (P1 to P6, comments, any maxval up to 65535) and BMP (8, 24
and 32 bits, either row order) with numpy only. `area_resize` averages exactly by
an integral image, a band of rows at a time. `npy_tiles` cuts an array into tiles in NPY format. A document's
bytes are stored as the samples of a binary pixmap and read back from it; the image
read back is resized to a thumbnail, which is written as an NPY tile, and hashed.

Null and empty texts store one row of spaces. Equal texts give equal values. Long
texts give tall images; besides its Arrow batch, which is bounded in bytes but for
one long text, a task works on one image at a time. Unreadable media decode to
None, and their columns are null. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._bytes import bytes_of
from verdigris.llm._shared import ship, small_batches, table

ROW_BYTES = 192
PIXELS = ROW_BYTES // 3


def encode_ppm(pixels: np.ndarray) -> bytes:
    """A height x width x 3 array of bytes as binary pixmap."""
    return b"P6\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def _netpbm(data: bytes) -> np.ndarray | None:
    kind, at, numbers = data[1] - 48, 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        while at < len(data) and data[at] in b" \t\r\n\v\f":
            at += 1
        if at < len(data) and data[at] == 35:
            while at < len(data) and data[at] not in b"\r\n":
                at += 1
            continue
        begin = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if begin == at:
            return None
        numbers.append(int(data[begin:at]))
    width, height, most = (*numbers, 1)[:3]
    planes = 3 if kind in (3, 6) else 1
    if not width or not height or not 0 < most < 65536:
        return None
    size = width * height * planes
    if kind == 1:
        digits = np.frombuffer(data[at:], np.uint8)
        values = 1 - (digits[(digits == 48) | (digits == 49)].astype(np.int64) - 48)
    elif kind in (2, 3):
        values = np.array(data[at:].split()[:size], dtype=np.int64)
    elif kind == 4:
        line = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, offset=at + 1)[: line * height]
        if len(packed) < line * height:
            return None
        values = 1 - np.unpackbits(packed.reshape(height, line), axis=1)[:, :width].astype(np.int64).ravel()
    else:
        sample = np.dtype(np.uint8 if most < 256 else ">u2")
        if len(data) - at - 1 < size * sample.itemsize:
            return None
        values = np.frombuffer(data, sample, count=size, offset=at + 1)
    if len(values) < size:
        return None
    values = values[:size].reshape(height, width, planes)
    return values if most == 255 and values.dtype == np.uint8 else (values.astype(np.float64) * 255 / most + 0.5).astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray | None:
    if len(data) < 54:
        return None
    start, header = struct.unpack_from("<II", data, 10)
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    rows, line = abs(height), (width * bits + 31) // 32 * 4
    if bits not in (8, 24, 32) or packing not in (0, 3) or width <= 0 or not rows or len(data) < start + line * rows:
        return None
    body = np.frombuffer(data, np.uint8, count=line * rows, offset=start).reshape(rows, line)[:, : width * bits // 8]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, count=used * 4, offset=14 + header).reshape(-1, 4)
        if body.max() >= used:
            return None
        pixels = palette[body][:, :, 2::-1]
    else:
        pixels = body.reshape(rows, width, bits // 8)[:, :, 2::-1]
    return pixels[::-1] if height > 0 else pixels


def decode(data: bytes | None) -> np.ndarray | None:
    """Height x width x planes bytes, or None."""
    try:
        if data and data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return _netpbm(data)
        return _bmp(data) if data and data[:2] == b"BM" else None
    except (ValueError, struct.error):
        return None


BAND = 4_096


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean grey over each target pixel's exact area, by bilinear reads of the integral image.

    The integral image grows by bands of rows, and only the two rows on either side of each target edge are kept, so
    a tall image needs no copy of itself.
    """
    rows, columns = image.shape[:2]
    y, x = np.arange(height + 1) * rows / height, np.arange(width + 1) * columns / width
    y0, x0 = np.minimum(y.astype(int), rows - 1), np.minimum(x.astype(int), columns - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    upper, lower, above = np.zeros((height + 1, columns + 1)), np.zeros((height + 1, columns + 1)), np.zeros(columns)
    for start in range(0, rows, BAND):
        band = image[start : start + BAND].astype(np.float64).mean(2).cumsum(0) + above
        whole = np.zeros((len(band) + 1, columns + 1))  # integral rows start to start + len(band)
        whole[0, 1:] = above.cumsum()
        whole[1:, 1:] = band.cumsum(1)
        for kept, at in ((upper, y0), (lower, y0 + 1)):
            here = (at >= start) & (at <= start + len(band))
            kept[here] = whole[at[here] - start]
        above = band[-1]
    at = upper[:, x0] * (1 - fy) * (1 - fx) + lower[:, x0] * fy * (1 - fx) + upper[:, x0 + 1] * (1 - fy) * fx + lower[:, x0 + 1] * fy * fx
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) * (height * width) / (rows * columns)


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as 16 hexadecimal digits: is a pixel of the 8 x 9 thumbnail darker than its right neighbour."""
    small = np.round(area_resize(image, 8, 9), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(array))
    return out.getvalue()


THUMBNAIL = 32


def thumbnail(image: np.ndarray, side: int = THUMBNAIL) -> bytes:
    """The image in side x side grey bytes, as an NPY tile."""
    return npy(np.round(area_resize(image, side, side)).clip(0, 255).astype(np.uint8))


def npy_tiles(image: np.ndarray, side: int = 64) -> Iterator[tuple[int, int, bytes]]:
    """(row, column, NPY file) of each tile; tiles at the edge are smaller."""
    for r in range(0, image.shape[0], side):
        for c in range(0, image.shape[1], side):
            yield r // side, c // side, npy(image[r : r + side, c : c + side])


def text_image(body: bytes) -> bytes:
    """A text as binary pixmap, padded with spaces to a positive multiple of ROW_BYTES."""
    padded = body + b" " * (-len(body) % ROW_BYTES or (0 if body else ROW_BYTES))
    return encode_ppm(np.frombuffer(padded, np.uint8).reshape(-1, PIXELS, 3))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text as a stored image."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("body"))
            images = (text_image(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"])

    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", body.alias("body")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, media binary")


def read_media(frame: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """The kept columns, and from each stored image: payload figures, the media's hash, a difference hash, and the thumbnail's NPY tile with its hash."""
    small_batches(frame.sparkSession)
    kinds = dict(frame.dtypes)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_sha256", "tile"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.column("media"):
                stored = item.as_py()
                image = decode(stored)
                if image is None:
                    rows.append((None,) * 8)
                    continue
                payload = np.ascontiguousarray(image).reshape(-1)
                tile = thumbnail(image)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), difference_hash(image), hashlib.sha256(tile).hexdigest(), tile))
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(c, t) for c, t in zip(columns, types)], keep + names)

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string, tile binary"
    return frame.select(*keep, F.col(media).alias("media")).mapInArrow(run, schema)


def media_tiles(frame: DataFrame, key: str, media: str = "media", side: int = 64) -> DataFrame:
    """(key, tile_row, tile_column, npy) of each decodable image."""
    small_batches(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, item in zip(batch.column("key").to_pylist(), batch.column("media")):
                image = decode(item.as_py())
                if image is not None:
                    r, c, n = zip(*npy_tiles(image, side))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(r), batch.column("key").type), pa.array(r, pa.int32()), pa.array(c, pa.int32()), pa.array(n, pa.binary())], [key, "tile_row", "tile_column", "npy"])

    return frame.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(run, f"`{key}` {dict(frame.dtypes)[key]}, tile_row int, tile_column int, npy binary")


def op5_media(spark, sf_dir: str) -> DataFrame:
    return read_media(text_media(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"]).drop("tile")


ship(__name__)
