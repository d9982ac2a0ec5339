"""K-mers of reads: two bits a base (A 0, C 1, G 2, T 3; other letters but N as A)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import nt

K = 8
_TWO = np.zeros(256, np.uint8)
_TWO[[2, 4, 8]] = 1, 2, 3


def kmer_codes(mask: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the k-mers that end at each base of rows of nucleotide sets, and which of them count.

    The first k-mer of a read, and the first after an N, do not count.
    """
    # k bases and their codes by doubling: a code of a + b bases is one of a bases, moved, and one of b bases
    n, length = mask.shape
    code, have, step, width, left = np.zeros((n, length), np.int32 if k < 16 else np.int64), 0, _TWO[mask].astype(np.int32 if k < 16 else np.int64), 1, k
    while left:
        if left & 1:
            code[:, have:] |= step[:, : max(length - have, 0)] << (2 * have)
            have += width
        left >>= 1
        if left:
            longer = step.copy()
            longer[:, width:] |= step[:, : max(length - width, 0)] << (2 * width)
            step, width = longer, 2 * width
    at = np.arange(length, dtype=np.int32)
    ok = np.empty((n, length), bool)
    ok[:] = at > k - 1
    rows = np.flatnonzero((mask == 15).any(1))
    if len(rows):
        last_n = np.maximum.accumulate(np.where(mask[rows] == 15, at, np.int32(-1)), 1)
        ok[rows] = at - last_n > k
    return code, ok


def kmers(seq: Column, k: int = K) -> Column:
    """array<struct<posn, kmer>> of a read's k-mers with the end position of each, from 0; those with an N are left out."""
    upper = F.upper(seq)
    each = F.transform(F.sequence(F.lit(k), F.length(seq)), lambda e: F.struct((e - 1).alias("posn"), F.substring(upper, e - k + 1, F.lit(k)).alias("kmer")))
    counted = F.filter(each, lambda e: ~F.contains(F.substring(upper, F.greatest(e["posn"] - k + 1, F.lit(1)), F.lit(k + 1)), F.lit("N")) & (e["posn"] >= k))
    return F.when(F.length(seq) > k, counted).otherwise(F.array().cast("array<struct<posn:int,kmer:string>>"))


def packed(mask: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the k bases that end at each place of sequences one behind another (their sets and lengths), and the bases since the last N or
    start, that one left out.

    A code of a + b bases is one of a bases, moved, and one of b bases: so any k takes some log2(k) steps over the data.
    """
    two = np.zeros(len(mask), np.int64)
    two[mask == 2], two[mask == 4], two[mask == 8] = 1, 2, 3
    code, have, step, width = np.zeros(len(mask), np.int64), 0, two, 1
    left = k
    while left:
        if left & 1:  # ``step`` bases in front of those that ``code`` has
            moved = np.zeros_like(step)
            moved[have:] = step[: len(step) - have] if have else step
            code |= moved << (2 * have)
            have += width
        left >>= 1
        if left:
            before = np.zeros_like(step)
            before[width:] = step[:-width] if width < len(step) else step[:0]
            step, width = (before << (2 * width)) | step, 2 * width
    at = np.arange(len(mask))
    first = np.repeat(np.cumsum(length) - length, length)
    last = np.maximum.accumulate(np.where(mask == 15, at, -1))
    return code, at - np.maximum(last, first - 1)


def kmer_table(df: DataFrame, seq: str, k: int, *, key: str = "ordinal", reverse: bool = False, complement: bool = False, as_iterated: bool = False) -> DataFrame:
    """A row (key, posn, kmer) for each k-mer of a sequence, k from 1 to 31: the place of its last base in the order of reading, from 0, and two bits
    a base as a long.  ``seq`` is any column of bases: a read, its complement, or a merged sequence.

    As in the kernel, the first k-mer of a sequence and the first after an N are left out.  ``reverse`` reads from the end.  ``as_iterated``: the codes that the
    reference's iterator returns, which forgets all bases but the last at each step, so only the first k-mer after a start or an N is whole.
    """
    if not 1 <= k <= 31:
        raise ValueError("k must lie between 1 and 31")
    kind = df.schema[key].dataType.simpleString()
    table = nt.FROM_ASCII_COMPLEMENT if complement else nt.FROM_ASCII

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators import clip

        for b in batches:
            buf, start, length = clip.ranges(b.column(seq))
            size = np.maximum(length, 0)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            if reverse:
                place = np.repeat(size, size) - 1 - place
            mask = table[buf[np.repeat(start, size) + place]] if len(row) else np.zeros(0, np.uint8)
            code, run_length = packed(mask, size, k)
            if as_iterated:
                code = np.where(run_length > k + 1, code & 3, code)
            at = np.flatnonzero(run_length > k)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row[at])), pa.array(place[at].astype(np.int32)), pa.array(code[at])], [key, "posn", "kmer"])

    return df.select(key, seq).mapInArrow(run, f"`{key}` {kind}, posn int, kmer long")
