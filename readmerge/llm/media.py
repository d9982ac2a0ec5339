"""Media columns: payloads kept as lossless WebP pictures, read back from storage and described.

A payload of bytes is padded with zeros to a positive multiple of 64 and coded as 8-bit samples (green, red, blue, alpha
of one pixel after the other, 16 pixels a row, wider beyond 16384 rows).  Files are written to the shared folder as a
binary column; decoding runs over that scan.

Defined cases: null counts as empty (a picture of zeros); a payload whose rows do not fill the picture has zero rows at
its end, and the payload's own length is stored beside the file; equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch, text as tx, vp8l

UNIT = 64
ROW = 16  # pixels of a row: one unit
MOST_ROWS = 16_384


def store(payload: bytes) -> bytes:
    """The WebP file of a payload whose length is a multiple of UNIT."""
    units = len(payload) // UNIT
    wide = -(-units // MOST_ROWS)
    height = -(-units // wide)
    samples = np.frombuffer(payload + bytes(wide * height * UNIT - len(payload)), np.uint8)
    return vp8l.encode(samples, ROW * wide, height)


def load(media: bytes, n: int) -> tuple[int, int, bytes]:
    """Width, height and the first n payload bytes of a stored file."""
    width, height, px = vp8l.decode(media)
    return width, height, px[:, [2, 1, 3, 0]].tobytes()[:n]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = tx.buffer_of(batch.column("text"))
        for lo, hi in tx.slices(off, 4 * tx.SLICE):
            seen, media, sizes, padded = {}, [], [], []
            for a, b in zip(off[lo:hi].tolist(), off[lo + 1 : hi + 1].tolist(), strict=True):
                raw = buf[a:b].tobytes()
                n = max(UNIT, -(-len(raw) // UNIT) * UNIT)
                if raw not in seen:
                    seen[raw] = store(raw + bytes(n - len(raw)))
                media.append(seen[raw])
                sizes.append(len(raw))
                padded.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(padded, pa.int64()), pa.array(media, pa.binary())], ["key", "n_bytes", "payload_bytes", "media"])


def describe(width: int, height: int, payload: bytes) -> str:
    """Features of a picture: its size, mean and deviation of samples, entropy in bits, distinct values."""
    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = count / count.sum()
    mean = p @ np.arange(256)
    some = p[p > 0]
    return f"{width}x{height} mean={mean:.3f} dev={np.sqrt(max(p @ np.arange(256) ** 2 - mean**2, 0)):.3f} entropy={max(0.0, -(some @ np.log2(some))):.3f} distinct={len(some)}"


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows, seen = [], {}
        for n, media in zip(batch.column("payload_bytes").to_pylist(), batch.column("media").to_pylist(), strict=True):
            sha = hashlib.sha256(media).hexdigest()
            if (sha, n) not in seen:
                width, height, payload = load(media, n)
                seen[sha, n] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha, describe(width, height, payload))
            rows.append(seen[sha, n])
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n_bytes"), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names)


def to_media(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, payload_bytes and media (the file) of every row, stored in the shared folder."""
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return scratch.materialize(src.mapInArrow(_pack, f"key {kind}, n_bytes long, payload_bytes long, media binary"), "media")


def read_media(stored: DataFrame) -> DataFrame:
    """Decode stored files: digests, sizes and features of every row."""
    kind = stored.schema["key"].dataType.simpleString()
    shape = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(_unpack, shape)


def op8_media(spark, sf_dir: str) -> DataFrame:
    return read_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))).withColumnRenamed("key", "doc_id")
