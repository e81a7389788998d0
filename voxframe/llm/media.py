"""Media columns: texts as grey-scale PNG images in a binary column, read back with checksum tests, and hashed perceptually.

PNG is written and read here by its specification: signature, IHDR, IDAT (zlib), IEND, each chunk with its CRC-32; rows
carry one of five filters, undone with numpy. The perceptual hash is the sign pattern of the low frequencies of a cosine
transform. Edge cases: null and empty texts give 24 rows of padding; equal texts give equal images and hashes; a damaged
image raises ValueError, as its reader must not return other bytes than were stored.
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

from voxframe.llm.arrow import slices

SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
UNIT, WIDTH, PAD, LEVEL = 576, 24, 255, 6
SIDE, LOW = 32, 8


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def payload(text: bytes, unit: int = UNIT) -> bytes:
    return text + bytes([PAD]) * (-len(text) % unit if text else unit)


SAMPLED = 64


def png(samples: bytes, width: int = WIDTH, level: int = LEVEL) -> bytes:
    """An 8-bit grey image of rows of width samples. All rows get the filter, of none, left and up, whose differences
    are smallest in sum on the first SAMPLED rows, or none unless another is smaller by a third; that is a choice of size alone,
    as every row is written and each filter is undone without loss."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    left, up = rows.copy(), rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    by_filter = [rows, left, up]
    cost = [np.minimum(f[:SAMPLED], 0 - f[:SAMPLED]).sum(dtype=np.int64) for f in by_filter]
    kind = int(np.argmin(cost)) if cost[0] * 2 > min(cost) * 3 else 0
    out = np.empty((len(rows), width + 1), dtype=np.uint8)
    out[:, 0], out[:, 1:] = kind, by_filter[kind]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray) -> np.ndarray:
    """Rows of one-byte samples, each after its filter byte."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if (kinds == 0).all():
        return rows
    if (kinds == 1).all():
        return np.cumsum(rows, axis=1, dtype=np.uint8)
    if (kinds == 2).all():
        return np.cumsum(rows, axis=0, dtype=np.uint8)
    above = np.zeros(rows.shape[1], dtype=np.uint8)
    for k, kind in enumerate(kinds):
        row = rows[k]
        if kind == 1:
            row[:] = np.cumsum(row, dtype=np.uint8)
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            before = corner = 0
            for i, over in enumerate(above.tolist()):
                if kind == 3:
                    guess = (before + over) // 2
                else:
                    far = [(abs(over - corner), 0, before), (abs(before - corner), 1, over), (abs(before + over - 2 * corner), 2, corner)]
                    guess = min(far)[2]
                before = (int(row[i]) + guess) & 255
                row[i], corner = before, over
        elif kind != 0:
            raise ValueError(f"PNG: filter {kind}")
        above = row
    return rows


def samples(image: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG; ValueError if a checksum, a length or the kind is not as it must be."""
    if image[:8] != SIGNATURE:
        raise ValueError("PNG: signature")
    at, data, head = 8, [], None
    while True:
        if at + 12 > len(image):
            raise ValueError("PNG: cut short")
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if len(body) != size or at + 12 + size > len(image) or struct.unpack_from(">I", image, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"PNG: checksum of {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("PNG: not 8-bit grey without interlace")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8)
    if len(raw) != head[1] * (head[0] + 1):
        raise ValueError("PNG: amount of samples")
    return _unfilter(raw.reshape(head[1], head[0] + 1))


def _pooled(n: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.arange(SIDE + 1) * n // SIDE
    return np.minimum(edge[:-1], n - 1), np.maximum(edge[1:] - edge[:-1], 1)


_k = np.arange(LOW)[:, None]
COSINE = np.cos(np.pi * _k * (2 * np.arange(SIDE) + 1) / (2 * SIDE))


def perceptual(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the image, averaged to 32 x 32, lie above their median."""
    (a, na), (b, nb) = _pooled(image.shape[0]), _pooled(image.shape[1])
    total = np.add.reduceat(image, b, axis=1, dtype=np.int64) / nb
    if image.shape[0] >= SIDE:
        total = np.add.reduceat(total, a, axis=0) / na[:, None]
    else:
        total = total[a]
    low = np.round(COSINE @ total @ COSINE.T, 6)
    return np.packbits(low > np.median(low.ravel()[1:])).tobytes()


def encode(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes (of the text as UTF-8) and media, the PNG of the padded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([png(payload(t), width) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads column media of doc_id, n_bytes, media: facts of the bytes read back and of the stored form, and phash."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "phash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, images in slices(batches, "media"):
            rows = []
            for image in images:
                grid = samples(image)
                back = grid.tobytes()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(image), hashlib.sha256(image).hexdigest(), perceptual(grid)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, phash binary")
