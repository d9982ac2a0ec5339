"""Best-fit packing of tokenised documents into sequences by minimum bin slack.

Texts are tokenised whole (one map; each distinct white-space word is encoded once and its ids kept).  Only documents
longer than a sequence are cut.  Packing needs the counts of piece lengths alone, at most ``capacity`` numbers: for each
bin the longest waiting length is set and a bitset subset-sum over the other lengths finds the fullest combination,
which is removed as often as the counts allow.  The resulting patterns then deal ranks of each length to sequences.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import scratch, text as tx
from .numbering import number_rows

#: Distinct words that a worker remembers before it begins anew.
REMEMBERED = 1_000_000


#: 1: ASCII letters and digits; 2: other ASCII but the apostrophe; 3: all else that is no white space.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[33:127] = 2
_CLASS[[c for c in range(128) if chr(c).isalnum()]] = 1
_CLASS[39] = 3
_CLASS[~tx.NONSPACE] = 0
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


def chunks(buf: np.ndarray, off: np.ndarray, fold: bool = False) -> tx.Words:
    """Pieces of a slice's texts that a word tokenizer never joins: white-space words, cut between ASCII letters or
    digits and ASCII punctuation.  There is no cut beside an apostrophe (contractions) or a character beyond ASCII
    (which may combine with its neighbour), nor where a special token's own text occurs.  Hashes are of the bytes as they are, or with ``fold``
    of those with A-Z lower-cased.
    """
    hashed = tx.LOWER[buf] if fold else buf
    data = buf.tobytes()
    if not len(buf) or any(x in data for x in _SPECIAL):
        w = tx.words(buf, off, tx.NONSPACE, hashed=False)
        return tx.Words(w.start, w.end, tx.word_hash(hashed, w.start, w.end), w.off)
    c = _CLASS[buf]
    step = (c[1:] ^ c[:-1]) == 3  # classes 1 and 2 meet
    edge = np.zeros(len(c) + 1, bool)
    edge[off] = True
    edge[1:-1] |= step | (c[:-1] == 0) | (c[1:] == 0)
    some = c > 0
    start, end = np.flatnonzero(some & edge[:-1]), np.flatnonzero(some & edge[1:]) + 1
    return tx.Words(start, end, tx.word_hash(hashed, start, end), np.searchsorted(start, off))


def lower_cases(path: str) -> bool:
    """Whether a tokenizer's own settings say that it lower-cases every text first."""
    with open(path, encoding="utf-8") as f:
        first = json.load(f).get("normalizer") or {}
    steps = first.get("normalizers", []) if first.get("type") == "Sequence" else [first]
    return any(x.get("type") == "Lowercase" or x.get("type") == "BertNormalizer" and x.get("lowercase") for x in steps)


class WordTokens:
    """Ids of pieces, remembered by hash.  Exact for tokenizers that never join across white space; case counts unless the tokenizer lower-cases."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.fold = lower_cases(path)
        self.reset()

    def reset(self):
        self.known, self.at, self.n, self.ids = np.zeros(0, tx.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def lookup(self, buf: np.ndarray, w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words of a slice in order, and the number of each word."""
        order = np.argsort(w.hash)
        h = w.hash[order]
        lead = np.ones(len(h), bool)
        lead[1:] = h[1:] != h[:-1]
        back = np.empty(len(h), np.int64)
        back[order] = np.cumsum(lead) - 1
        h, first = h[lead], order[lead]
        place = np.searchsorted(self.known, h)
        new = np.ones(len(h), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != h
        if new.any():
            if len(self.known) + new.sum() > REMEMBERED:
                self.reset()
                new[:] = True
            data = buf.tobytes()
            got = [e.ids for e in self.tok.encode_batch_fast([data[a:b].decode() for a, b in zip(w.start[first[new]].tolist(), w.end[first[new]].tolist(), strict=True)], add_special_tokens=False)]
            n = np.array([len(g) for g in got])
            at = len(self.ids) + np.cumsum(n) - n
            self.ids = np.concatenate([self.ids, np.fromiter((i for g in got for i in g), np.uint32, int(n.sum()))])
            known = np.concatenate([self.known, h[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.at, self.n = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.n, n])[order]
            place = np.searchsorted(self.known, h)
        n = self.n[place][back]
        return self.ids[tx.expand(self.at[place][back], n)], n


_tokens: dict[str, WordTokens] = {}


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens.get(path) or _tokens.setdefault(path, WordTokens(path))
        for batch in batches:
            buf, off = tx.buffer_of(batch.column("text"))
            for lo, hi in tx.slices(off):
                own = buf[off[lo] : off[hi]]
                w = chunks(own, off[lo : hi + 1] - off[lo], tokens.fold)
                ids, n = tokens.lookup(own, w)
                c = np.concatenate([[0], np.cumsum(n)])
                size = c[w.off[1:]] - c[w.off[:-1]] + 1
                bound = np.concatenate([[0], np.cumsum(size)])
                flat = np.empty(bound[-1], "<u4")
                body = np.ones(len(flat), bool)
                body[bound[1:] - 1] = False
                flat[body], flat[~body] = ids, end
                many = -(-size // capacity)
                doc = np.repeat(np.arange(hi - lo), many)
                piece = tx.expand(np.zeros(hi - lo, np.int64), many)
                start = piece * capacity
                length = np.minimum(size[doc] - start, capacity)
                a = bound[:-1][doc] + start
                view = memoryview(flat).cast("B")
                crc = [zlib.crc32(view[4 * x : 4 * (x + y)]) for x, y in zip(a.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(lo, hi - lo).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    ["key", "piece", "start", "length", "ids_crc32"],
                )

    return run


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats, as counts allow) of the largest sum up to ``room``, by a bitset of reachable sums."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for size in sorted((x for x in counts if x <= room), reverse=True):
        for _ in range(min(counts[size], room // size)):
            more = (reach | reach << size) & mask
            if more == reach:
                break
            steps.append((size, reach))
            reach = more
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        if not before >> left & 1:
            out.append(size)
            left -= size
    return out


def pack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, {length: copies}) that use up all counts."""
    counts = {k: v for k, v in counts.items() if v}
    out = []
    while counts:
        top = max(counts)
        counts[top] -= 1
        pattern = Counter([top, *fullest({k: v for k, v in counts.items() if v}, capacity - top)])
        counts[top] += 1
        times = min(counts[k] // n for k, n in pattern.items())
        out.append((times, dict(pattern)))
        for k, n in pattern.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return out


def _deal(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset), sorted: which ranks of a length go where."""
    used, rows, sequence = Counter(), [], 0
    for times, pattern in patterns:
        offset = 0
        for size, n in sorted(pattern.items(), reverse=True):
            rows.append((size, used[size], n, sequence, offset))
            used[size] += times * n
            offset += size * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        lengths, first = np.unique(t[:, 0], return_index=True)
        last = np.append(first[1:], len(t))
        for batch in batches:
            size, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order])) + 1
            for part in np.split(order, cuts) if len(order) else ():
                k = np.searchsorted(lengths, size[part[0]])
                row[part] = first[k] + np.searchsorted(t[first[k] : last[k], 1], rank[part], "right") - 1
            extra = rank - t[row, 1]
            cols = [batch.column(c) for c in ("key", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(t[row, 3] + extra // t[row, 2]), pa.array(t[row, 4] + extra % t[row, 2] * size)], ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    shape = f"key {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = scratch.materialize(src.mapInArrow(_pieces(tokenizer, capacity, end), shape), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` numbers
    table = docs.sparkSession.sparkContext.broadcast(_deal(pack(counts, capacity)))
    ranked = number_rows(pieces, "length", ["key", "piece", "ids_crc32"], "rank")
    return ranked.mapInArrow(_place(table), f"{shape}, sequence_id long, offset long").withColumnRenamed("key", key)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
