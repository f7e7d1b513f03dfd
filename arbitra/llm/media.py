"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, written as NPY tiles with difference hashes."""

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

from .common import ready, text_of, trimmed

#: Width of a payload image: WIDTH RGB samples are 192 bytes.
WIDTH = 64
TILE = (32, 32)


class MediaError(ValueError):
    """Bytes that aren't an image of a supported kind."""


def encode_netpbm(image: np.ndarray) -> bytes:
    """P6 for height x width x 3, P5 for height x width; 8-bit samples."""
    kind = b"P6" if image.ndim == 3 else b"P5"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit uncompressed BMP, rows from the bottom, each padded to four bytes."""
    rgb = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, axis=2)
    height, width = rgb.shape[:2]
    rows = np.zeros((height, -(-width * 3 // 4) * 4), np.uint8)
    rows[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + rows.size, 0, 0, 54, 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def _tokens(data: bytes, count: int) -> tuple[list[int], int]:
    """Header numbers of a Netpbm file, comments skipped, and where its samples begin."""
    found, at = [], 2
    while len(found) < count:
        while at < len(data) and (data[at] in b" \t\r\n\v\f" or data[at] == 35):
            at = (data.find(b"\n", at) if data[at] == 35 else at) + 1
            if at == 0:
                raise MediaError("a comment without an end")
        begin = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if begin == at:
            raise MediaError("a number is missing in the header")
        found.append(int(data[begin:at]))
    return found, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 (bits as 0 and 255, wider samples scaled to 255)."""
    kind = data[1:2]
    bitmap, plain = kind in b"14", kind in b"123"
    (width, height, *rest), at = _tokens(data, 2 if bitmap else 3)
    most, channels = (rest or [1])[0], 3 if kind in b"36" else 1
    if not 0 < most < 65536 or not width or not height:
        raise MediaError("a size or maximum out of range")
    count = width * height * channels
    if plain:
        body = re.sub(rb"#[^\n]*", b"", data[at - 1 :]).split()
        # the bits of a P1 file need no blanks between them
        values = np.frombuffer(b"".join(body), np.uint8).astype(np.int64) - 48 if bitmap else np.array(body, np.int64)
    elif bitmap:
        stride = -(-width // 8)
        values = np.unpackbits(np.frombuffer(data, np.uint8, stride * height if len(data) - at >= stride * height else 0, at).reshape(-1, stride), axis=1)[:, :width].ravel()
    else:
        sample = np.dtype(">u2" if most > 255 else np.uint8)
        values = np.frombuffer(data, sample, min(count, (len(data) - at) // sample.itemsize), at)
    if len(values) < count:
        raise MediaError("the image ends early")
    values = values[:count]
    if values.min() < 0 or values.max() > most:
        raise MediaError("a sample out of range")
    if bitmap:
        values = np.where(values, 0, 255)
    elif most != 255:
        values = (values.astype(np.int64) * 255 + most // 2) // most
    return values.astype(np.uint8).reshape((height, width, 3) if channels == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8, 24 and 32-bit BMP as height x width x 3."""
    if len(data) < 54:
        raise MediaError("the header ends early")
    offset, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or not height:
        raise MediaError("this kind of BMP isn't supported")
    if packing == 3 and (bits != 32 or struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise MediaError("these channel masks aren't supported")
    stride, rows = -(-width * bits // 32) * 4, abs(height)
    if len(data) < offset + stride * rows:
        raise MediaError("the image ends early")
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    if height > 0:
        raw = raw[::-1]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        if used > 256:
            raise MediaError("the palette is too large")
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(-1, 4)
        return palette[raw[:, :width]][:, :, 2::-1].copy()
    return raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    """The image in Netpbm or BMP bytes. Whatever is wrong with them is a MediaError."""
    try:
        if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
            return decode_netpbm(data)
        if data[:2] == b"BM":
            return decode_bmp(data)
    except (ValueError, IndexError, OverflowError, struct.error) as error:
        raise error if isinstance(error, MediaError) else MediaError(f"malformed: {error}"[:200]) from error
    raise MediaError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of equal areas, edges weighted by the share they cover, as float64 height x width (x channels).

    The integral image gives the sum over any rectangle from four corners; at fractional corners it
    is interpolated, which is exact as the image is constant inside a pixel.
    """

    def corners(table: np.ndarray, parts: int, axis: int) -> np.ndarray:
        size = table.shape[axis] - 1
        cuts = np.arange(parts + 1) * size / parts
        low = np.minimum(cuts.astype(np.int64), size - 1)
        share = (cuts - low).reshape([-1 if a == axis else 1 for a in range(table.ndim)])
        return table.take(low, axis) * (1 - share) + table.take(low + 1, axis) * share

    table = np.zeros((image.shape[0] + 1, image.shape[1] + 1, *image.shape[2:]))
    table[1:, 1:] = image.cumsum(0, dtype=np.float64).cumsum(1)
    at = corners(corners(table, height, 0), width, 1)
    sums = at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]
    return sums * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 areas of the grey image is darker than its right neighbour."""
    grey = image @ np.array([0.299, 0.587, 0.114]) if image.ndim == 3 else image
    small = np.round(area_resize(grey, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy_tile(image: np.ndarray, height: int = TILE[0], width: int = TILE[1]) -> bytes:
    """The area-resized image as the bytes of an NPY file of uint8."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(image, height, width)), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


TILES = "height int, width int, channels int, tile binary, difference_hash string, error string"


def tiles(media: DataFrame, column: str = "media", id_column: str = "doc_id", height: int = TILE[0], width: int = TILE[1]) -> DataFrame:
    """The id and TILES of each media value: decoded, resized, as NPY bytes with its difference hash.

    Null or undecodable bytes keep their row, with the reason in ``error`` and the rest null. Repeated
    rows each get a row; other columns are ignored; no rows give no rows.
    """
    ready(media.sparkSession)

    def run(batches):
        held: list[list] = []

        def out():
            columns = zip(*held, strict=True) if held else [()] * len(TYPES)
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, TYPES, strict=True)], names=["id", "height", "width", "channels", "tile", "difference_hash", "error"])

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    if (data := value.as_py()) is None:
                        raise MediaError("null")
                    image = decode(data)
                    row = [*image.shape[:2], 1 if image.ndim == 2 else 3, npy_tile(image, height, width), f"{difference_hash(image):016x}", None]
                except MediaError as error:
                    row = [None] * 5 + [str(error)]
                held.append([key, *row])
                if len(held) == 256:
                    yield out()
                    held.clear()
        yield out()

    TYPES = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
    found = media.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("binary").alias("media"))
    return found.mapInArrow(trimmed(run), f"id long, {TILES}").withColumnRenamed("id", id_column)


def payload_image(data: bytes) -> np.ndarray:
    """Bytes as rows of WIDTH RGB samples, filled with spaces to at least one whole row."""
    row = WIDTH * 3
    padded = data.ljust(max(1, -(-len(data) // row)) * row, b" ")
    return np.frombuffer(padded, np.uint8).reshape(-1, WIDTH, 3)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text stored losslessly as a Netpbm image. Null text is empty text."""
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode()
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([encode_netpbm(payload_image(data))], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(trimmed(run), "doc_id long, n_bytes long, media binary")


def media_features(docs: DataFrame) -> DataFrame:
    """DIGESTS of every row of ``docs``: stored as an image, read back, hashed and tiled, in one pass without a shuffle.

    feature joins the difference hash and the SHA-256 of the NPY tile. Null text is empty text, which fills
    one row of spaces. A null doc_id stays null; repeated rows each get a row; other columns are ignored.
    """
    ready(docs.sparkSession)
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode()
                media = encode_netpbm(payload_image(data))
                image = decode(media)
                payload = image.tobytes()
                feature = f"{difference_hash(image):016x}:{hashlib.sha256(npy_tile(image)).hexdigest()}"
                row = (key, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(trimmed(run), DIGESTS)
