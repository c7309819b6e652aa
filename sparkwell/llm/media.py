"""Media columns: PNG images in binary columns, and their perceptual hashes.

The decoder reads a PNG chunk by chunk, tests every checksum, inflates the image
data and undoes the five scanline filters with numpy; 8-bit grey and RGB(A)
images without interlacing are supported. The hash takes the low frequencies of
a two-dimensional cosine transform of the image, shrunk to 32 by 32.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_text, materialize

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row of a stored payload.
WIDTH = 192
#: Samples per pixel of the PNG colour types that are read.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _filtered(rows: np.ndarray, step: int) -> np.ndarray:
    """Scanlines with their filter bytes; each row takes none, left or up, whichever has the least sum of absolute differences."""
    left, up = rows.copy(), rows.copy()
    left[:, step:] -= rows[:, :-step]
    up[1:] -= rows[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64) for x in (rows, left, up)])
    kind = cost.argmin(0).astype(np.uint8)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = np.where((kind == 0)[:, None], rows, np.where((kind == 1)[:, None], left, up))
    return out


def encode_png(samples: np.ndarray, level: int = 1) -> bytes:
    """PNG of an 8-bit array, (rows, columns) or (rows, columns, channels).

    Written without filters and with chosen ones; the smaller of both stays.
    """
    height, width = samples.shape[:2]
    channels = samples.shape[2] if samples.ndim == 3 else 1
    colour = next(c for c, n in CHANNELS.items() if n == channels)
    rows = np.ascontiguousarray(samples, np.uint8).reshape(height, width * channels)
    plain = np.zeros((height, rows.shape[1] + 1), np.uint8)
    plain[:, 1:] = rows
    data = min((zlib.compress(x.tobytes(), level) for x in (plain, _filtered(rows, channels))), key=len)
    header = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Undo the scanline filters. Rows that depend on nothing, or on the left or the row above alone, go in runs of equal filters."""
    lines = raw.reshape(height, stride + 1)
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for i, j in zip(np.r_[0, edges], np.r_[edges, height], strict=True):
        kind = kinds[i]
        if kind == 1:
            for c in range(step):
                out[i:j, c::step] = np.cumsum(out[i:j, c::step], axis=1, dtype=np.uint8)
        elif kind == 2:
            if i:
                out[i] += out[i - 1]
            out[i:j] = np.cumsum(out[i:j], axis=0, dtype=np.uint8)
        elif kind >= 3:
            for y in range(i, j):
                _sequential(out[y], out[y - 1] if y else np.zeros(stride, np.uint8), int(kind), step)
    return out


def _sequential(line: np.ndarray, above: np.ndarray, kind: int, step: int) -> None:
    """Average and Paeth rows, whose samples depend on the ones before them: pixel by pixel, channels at once."""
    up = above.astype(np.int32)
    left, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
    for x in range(0, len(line), step):
        b = up[x : x + step]
        if kind == 3:
            guess = (left + b) >> 1
        else:
            p = left + b - corner
            pa_, pb, pc = np.abs(p - left), np.abs(p - b), np.abs(p - corner)
            guess = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, b, corner))
        left = (line[x : x + step] + guess) & 255
        line[x : x + step] = left
        corner = b


def decode_png(data: bytes) -> np.ndarray:
    """The samples, (rows, columns) or (rows, columns, channels). Damaged data raise ValueError."""
    view = memoryview(data)
    if bytes(view[:8]) != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, ended = 8, None, False
    inflate, parts = zlib.decompressobj(), []
    while not ended:
        if at + 12 > len(view):
            raise ValueError("truncated PNG")
        (size,) = struct.unpack(">I", view[at : at + 4])
        kind, body = bytes(view[at + 4 : at + 8]), view[at + 8 : at + 8 + size]
        check = view[at + 8 + size : at + 12 + size]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("checksum of a chunk differs")
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(inflate.decompress(body))
        elif kind == b"IEND":
            ended = True
        elif kind[0] < 97 and kind != b"PLTE":
            raise ValueError("unknown critical chunk")
    if header is None or not inflate.eof:
        raise ValueError("truncated image data")
    width, height, depth, colour, _, _, interlace = header
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit grey and RGB images without interlacing are read")
    step = CHANNELS[colour]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    if len(raw) != height * (width * step + 1):
        raise ValueError("size of the image data differs")
    out = _unfilter(raw, height, width * step, step)
    return out if step == 1 else out.reshape(height, width, step)


# ---------------------------------------------------------------- hash

_SIDE, _LOW = 32, 8
_COSINES = np.cos(np.pi * np.arange(_LOW)[:, None] * (2 * np.arange(_SIDE) + 1) / (2 * _SIDE))


def _shrink(samples: np.ndarray, side: int, axis: int) -> np.ndarray:
    """Means of ``side`` equal stretches; where there are fewer rows than that, the nearest row."""
    n = samples.shape[axis]
    edges = np.arange(side) * n // side
    if n < side:
        return samples.take(edges, axis)
    sums = np.add.reduceat(samples, edges, axis)
    shape = [1, 1]
    shape[axis] = side
    return sums / np.diff(np.r_[edges, n]).reshape(shape)


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 by 8 lowest frequencies are above their median; the constant one is not counted in the median."""
    grey = samples.astype(np.float64) if samples.ndim == 2 else samples[..., :3].mean(2)
    small = _shrink(_shrink(grey, _SIDE, 0), _SIDE, 1)
    low = np.round(_COSINES @ small @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


# ---------------------------------------------------------------- columns


def payload(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The bytes with spaces up to a positive multiple of ``width``, a row for each ``width`` bytes."""
    rows = max(1, -(-len(text) // width))
    out = np.full(rows * width, 32, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(rows, width)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, sizes, images, held = [], [], [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(images, pa.binary())], names=["doc_id", "n_bytes", "png"])  # noqa: B023, E731
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_buffer() if text.is_valid else b""
            docs.append(doc.as_py())
            sizes.append(len(raw))
            images.append(encode_png(payload(raw)))
            held += len(images[-1])
            if held >= 8 << 20:
                yield flush()
                docs, sizes, images, held = [], [], [], 0
        if docs:
            yield flush()


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, phash binary"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    for batch in batches:
        rows = []
        for doc, size, png in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            media = png.as_buffer()
            samples = decode_png(media)
            raw, phash = samples.tobytes(), cosine_hash(samples)
            rows.append((doc, size, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(media), hashlib.sha256(media).hexdigest(), phash.hex(), phash))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)


def store_images(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Table of (doc_id, n_bytes, png): each whole text, in UTF-8, as a grey image; stored in the shared folder and read from it."""
    body = clean_text(text).cast("binary")
    images = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("raw")).mapInArrow(_encoded, "doc_id long, n_bytes long, png binary")
    return materialize(images, "media", compression="uncompressed")


def image_features(images: DataFrame) -> DataFrame:
    """Decode stored images and describe what was read back; a damaged image fails the job."""
    return images.mapInArrow(_featured, _FEATURES)


def media_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with digests of the payload as read back and of the stored form, and its cosine hash.

    Null and empty texts give a payload of 192 spaces. Equal texts give equal
    values, in as many rows as there are. No row depends on another: there is no
    shuffle, and a task holds one Arrow batch. Columns of other names are ignored.
    """
    out = image_features(store_images(docs, key, text))
    return out if key == "doc_id" else out.withColumnRenamed("doc_id", key)
