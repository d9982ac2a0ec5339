"""Distinct texts in balanced groups: the common first step of the operators that compare all documents.

Equal texts form a class (SHA-256) whose id is its least key.  Classes are dealt to groups by digest, each group a few
compressed blocks of bounded size, so a group's texts are handled by one vectorised call and a text with millions of
copies is one entry.  Groups meet hash buckets of fingerprints in both directions: a group sends sorted arrays to each
bucket, and a bucket answers with a flag for each entry it got.  Both sides keep entries in an order that only the
content decides, so answers need no keys, and a lost task can be run again.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

from . import scratch, text as tx

#: Bytes of texts of a group.
GROUP_BYTES = 3_700_000
NO_KEY = np.iinfo(np.int64).max
BLOCK = "group int, source int, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block, byte planes apart (sorted or small numbers then take little room)."""
    out = [struct.pack("<B", len(arrays))]
    z = zstandard.ZstdCompressor(level=1)
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = z.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
        out += [struct.pack("<4sQQ", a.dtype.str.encode().ljust(4), len(a), len(raw)), raw]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    z = zstandard.ZstdDecompressor()
    for _ in range(data[0]):
        kind, n, size = struct.unpack_from("<4sQQ", data, at)
        at += 20
        kind = np.dtype(kind.decode().strip())
        raw = np.frombuffer(z.decompress(data[at : at + size], max_output_size=max(1, n * kind.itemsize)), np.uint8)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel() if n else np.zeros(0, kind))
        at += size
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first value first."""
    return np.diff(x, prepend=x.dtype.type(0))


def undelta(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=x.dtype)


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def group_count(docs: DataFrame, group_bytes: int) -> int:
    """Groups for a table with a column text, by the bytes of its texts: one aggregate that reads this column only."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(min(max(16, math.ceil(size / group_bytes)), 1 << 24))


#: Groups whose fingerprints one bucket takes, on average: a bucket has about as many entries as that many groups send in all.
GROUPS_A_BUCKET = 2


def bucket_count(groups: int) -> int:
    """Hash buckets for the fingerprints of some groups."""
    return -(-groups // GROUPS_A_BUCKET)


def whole_keys(docs: DataFrame) -> DataFrame:
    """``docs`` if its column key holds whole numbers."""
    if not isinstance(docs.schema["key"].dataType, IntegralType):
        raise TypeError(f"keys must be whole numbers, not {docs.schema['key'].dataType.simpleString()}")
    return docs


def _deal(groups: int):
    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            keys = batch.column("key").fill_null(NO_KEY).to_numpy()
            digest = np.frombuffer(b"".join(bytes.fromhex(x) for x in batch.column("digest").to_pylist()), np.uint8).reshape(-1, 32)
            buf, off = tx.buffer_of(batch.column("text"))
            view = digest.view("V32").ravel()
            _, first, back = np.unique(view, return_index=True, return_inverse=True)
            least = np.full(len(first), NO_KEY)
            np.minimum.at(least, back, keys)
            at = (digest[first, :8].copy().view(">u8").ravel() % tx.U64(groups)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else ():
                rows = first[part]
                size = off[rows + 1] - off[rows]
                raw = z.compress(b"".join(buf[a:b].tobytes() for a, b in zip(off[rows].tolist(), off[rows + 1].tolist(), strict=True)))
                data = pack(digest[rows].ravel(), least[part], size, np.frombuffer(raw, np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([at[part[0]]], pa.int32()), pa.array([0], pa.int32()), pa.array([data], pa.binary())], ["group", "source", "data"])

    return run


def deal(docs: DataFrame, groups: int) -> DataFrame:
    """Blocks (group, source, data) of the distinct texts of ``docs`` (columns key, text)."""
    src = whole_keys(docs).select(F.col("key").cast("long").alias("key"), "text", digest_of(F.col("text")).alias("digest"))
    return src.mapInArrow(_deal(groups), BLOCK)


class Texts:
    """Distinct texts of a group in order of digest: digests, least keys, bytes and offsets."""

    def __init__(self, blocks: list[bytes]):
        digests, keys, sizes, bodies = [], [], [], []
        for b in blocks:
            d, k, n, raw = unpack(b)
            digests.append(d.reshape(-1, 32))
            keys.append(k)
            sizes.append(n)
            bodies.append(zstandard.ZstdDecompressor().decompress(raw.tobytes(), max_output_size=max(1, int(n.sum()))))
        d = np.concatenate(digests)
        _, first, back = np.unique(d.view("V32").ravel(), return_index=True, return_inverse=True)
        self.key = np.full(len(first), NO_KEY)
        np.minimum.at(self.key, back, np.concatenate(keys))
        size = np.concatenate(sizes)
        start = np.cumsum(size) - size
        body = b"".join(bodies)
        self.digest = d[first]
        self.off = np.concatenate([[0], np.cumsum(size[first])])
        self.buf = np.frombuffer(b"".join(body[a : a + n] for a, n in zip(start[first].tolist(), size[first].tolist(), strict=True)), np.uint8)

    def __len__(self) -> int:
        return len(self.key)


def blocks_of(table: pa.Table) -> list[bytes]:
    return table.column("data").to_pylist()


def block_table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    """A table of blocks from (group, source, data)."""
    g, s, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(g, pa.int32()), pa.array(s, pa.int32()), pa.array(d, pa.binary())], names=["group", "source", "data"])


def by_bucket(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hash, and an order by bucket that keeps the given order inside."""
    at = ((h >> tx.U64(32)) % tx.U64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # short numbers sort faster
    return at, np.argsort(at, kind="stable")


def parts_of(at: np.ndarray, order: np.ndarray):
    """(bucket, places) for each bucket that occurs."""
    for part in np.split(order, np.flatnonzero(at[order][1:] != at[order][:-1]) + 1) if len(order) else ():
        yield int(at[part[0]]), part


def answers(table: pa.Table) -> dict[int, bytes]:
    """Blocks of a group by the bucket that sent them."""
    return dict(zip(table.column("source").to_pylist(), blocks_of(table), strict=True))


def members(docs: DataFrame) -> DataFrame:
    """(key, digest, n_bytes) of every row, written once."""
    return scratch.materialize(docs.select("key", digest_of(F.col("text")).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")), "members")
