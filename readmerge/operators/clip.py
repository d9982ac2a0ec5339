"""Primer search, trimming and overhang removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import nt
from ..functions.phred import PHRED_MAX, QUAL_SCORE, QUAL_SCORE_ERR, index_table
from .config import nucleotides


def primer_offsets(mask: np.ndarray, good: np.ndarray, bad: np.ndarray, primer: tuple[int, ...], threshold: float, penalty: float, semantics: str = "reference", length: np.ndarray | None = None) -> np.ndarray:
    """One more than the bases through the end of the best primer place of each left-aligned row; 0: none.

    ``good`` and ``bad`` are log-probabilities of a base being right and wrong; ``threshold`` is one too.  The
    reference divides by the bases before the window's end (not the primer's length) and never tries the last place.
    """
    n, width = mask.shape
    p = len(primer)
    most = width - p + (semantics != "reference")
    if most <= 0:
        return np.zeros(n, np.int64)
    total = np.zeros((n, most))
    for x, want in enumerate(primer):
        if want != 15:
            part = slice(x, x + most)
            total += np.where((mask[:, part] & want) != 0, good[:, part], bad[:, part])
    end = np.arange(most) + p
    value = np.exp(total / (end + 1 if semantics == "reference" else p)) - end * penalty
    value = np.where(np.isnan(value), -np.inf, value)
    if length is not None:
        value = np.where(end < length[:, None] + (semantics != "reference"), value, -np.inf)
    at = value.argmax(1)
    top = value[np.arange(n), at]
    return np.where(top > np.exp(p * threshold), at + p + 1, 0)


def padded(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Rows of bytes (0 behind their ends) from ranges of a buffer."""
    n, width = len(length), int(length.max(initial=0))
    if n and width and (length == width).all() and (np.diff(start) == width).all():  # rows of one length, one behind another
        return buf[int(start[0]) : int(start[0]) + n * width].reshape(n, width)
    at = np.arange(width)
    inside = at < length[:, None]
    return np.where(inside, buf[np.minimum(np.where(inside, start[:, None] + at, 0), max(len(buf) - 1, 0))] if len(buf) else 0, 0).astype(np.uint8)


def read_arrays(seq: np.ndarray, qual: np.ndarray, complement: bool, phred: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets and scores of rows of characters."""
    return (nt.FROM_ASCII_COMPLEMENT if complement else nt.FROM_ASCII)[seq], index_table(phred)[qual]


def ranges(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a string column; a null has length -1."""
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    none = col.is_null().to_numpy(zero_copy_only=False)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, off[:-1], np.where(none, -1, np.diff(off))


def chunks(size: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Rows in order of size, so many at a time that a matrix as wide as the longest has about ``cells`` cells."""
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        end = at + 1
        step = max(1, cells // max(1, int(size[order[at]])))
        end = min(len(order), at + step)
        while end - at > 1 and (end - at) * int(size[order[end - 1]]) > 2 * cells:
            end = at + (end - at) // 2
        yield np.sort(order[at:end])
        at = end


def quality_offsets(seq: pa.Array, qual: pa.Array, primer: tuple[int, ...], *, complement: bool, backwards: bool, threshold: float, penalty: float, phred: int) -> np.ndarray:
    """Primer offsets in reads of any lengths; 0 where a read is null or its quality is null or of another length."""
    (buf, start, length), (q_buf, q_start, q_length) = ranges(seq), ranges(qual)
    out = np.zeros(len(seq), np.int64)
    usable = np.flatnonzero((length > 0) & (length == q_length))
    for part in chunks(length[usable], 2_000_000):
        at = usable[part]
        n = length[at]
        mask, q = read_arrays(padded(buf, start[at], n), padded(q_buf, q_start[at], n), complement, phred)
        q = np.clip(q, 0, PHRED_MAX)
        if backwards:
            place = np.maximum(n[:, None] - 1 - np.arange(mask.shape[1]), 0)
            mask, q = np.take_along_axis(mask, place, 1), np.take_along_axis(q, place, 1)
        out[at] = primer_offsets(mask, QUAL_SCORE[q], QUAL_SCORE_ERR[q], primer, threshold, penalty, length=n)
    return out


def with_primer_offset(df: DataFrame, name: str, seq: str, qual: str, primer: str, *, reverse_read: bool = False, backwards: bool = False, threshold: float = 0.6, penalty: float = 0.0, phred: int = 33) -> DataFrame:
    """Add ``name``: the primer's offset in a read (0: not found).  Reverse reads are searched as complements."""
    want = nucleotides(primer, complement=reverse_read)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for b in batches:
            found = quality_offsets(b.column(seq), b.column(qual), want, complement=reverse_read, backwards=backwards, threshold=float(np.log(threshold)), penalty=penalty, phred=phred)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], [*b.schema.names, name])

    return df.mapInArrow(run, f"{kind}, {name} long")


def trim_overhangs(pairs: DataFrame, *, forward: str | None = None, reverse: str | None = None, threshold: float = 0.6, skip: bool = False, phred: int = 33) -> DataFrame:
    """Cut a primer, and all that follows it, from the end of reads.  Pairs without it go, unless ``skip``.

    Reads without scores of their own length count as reads without the primer.
    """
    for side, primer in (("f", forward), ("r", reverse)):
        if not primer:
            continue
        pairs = with_primer_offset(pairs, "_at", f"{side}_seq", f"{side}_qual", primer[::-1], reverse_read=side == "r", backwards=True, threshold=threshold, phred=phred)
        if not skip:
            pairs = pairs.where("_at > 0")
        for c in (f"{side}_seq", f"{side}_qual"):
            left = F.length(c) - F.greatest(F.col("_at") - 1, F.lit(0))
            pairs = pairs.withColumn(c, F.substring(F.col(c), F.lit(1), left.cast("int")))
        pairs = pairs.drop("_at")
    return pairs
